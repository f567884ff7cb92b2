"""The lexical mode in SQL: stopwords, stems and the cover density of an OR."""

from __future__ import annotations

from plumbline.functions import spanish as sp


def _list(words: list[str]) -> str:
    return ", ".join(f"'{w}'" for w in words)


def _ends(text: str, *ends: str) -> str:
    return "(" + " OR ".join(f"{text} LIKE '%{e}'" for e in ends) + ")"


def _less(*ends: str) -> str:
    """The base without one of some endings of one length, if that lies in R2."""
    n = len(ends[0])
    return f"CASE WHEN {_ends('b', *ends)} AND length(b) - {n} >= p2 THEN left(b, -{n}) ELSE b END"


def stems_sql(source: str, name: str = "stems") -> str:
    """CTEs up to name(w, term) for the distinct words w of a table."""
    at = lambda pattern: f"CASE WHEN regexp_matches(w, '{pattern}') THEN length(regexp_extract(w, '{pattern}')) ELSE length(w) END"
    end = lambda text, suffixes: f"regexp_extract({text}, '{sp.any_of(suffixes)}')"
    n = name
    return f"""{n}_a AS (SELECT w, {at(sp.R1)} AS p1, {at(sp.R2)} AS p2, {at(sp.RV)} AS pv, {end('w', sp.PRONOUNS)} AS e FROM (SELECT DISTINCT w FROM {source})),
{n}_b AS (SELECT *, substr(w, 1, length(w) - length(e)) AS b FROM {n}_a), {n}_c AS (SELECT *, {end('b', sp.BEFORE_PRONOUN)} AS v FROM {n}_b),
{n}_d AS (SELECT w, p1, p2, pv, CASE WHEN e <> '' AND v <> '' AND length(b) - length(v) >= pv AND (v <> 'yendo' OR b LIKE '%uyendo') THEN substr(b, 1, length(b) - length(v)) || translate(v, 'áéí', 'aei') ELSE w END AS x FROM {n}_c),
{n}_e AS (SELECT *, {end('x', sp.STEP_1)} AS e FROM {n}_d), {n}_f AS (SELECT *, substr(x, 1, length(x) - length(e)) AS b FROM {n}_e),
{n}_g AS (SELECT w, pv, x, CASE WHEN e = '' THEN NULL
  WHEN e = 'amente' THEN CASE WHEN length(b) < p1 THEN NULL WHEN b LIKE '%ativ' AND length(b) - 4 >= p2 THEN left(b, -4) ELSE {_less('iv', 'os', 'ic', 'ad')} END
  WHEN length(b) < p2 THEN NULL WHEN e IN ({_list(sp.IN_R2)}) THEN b WHEN e IN ({_list(sp.AFTER_IC)}) THEN {_less('ic')}
  WHEN e IN ({_list(sp.LOG)}) THEN b || 'log' WHEN e IN ({_list(sp.U)}) THEN b || 'u' WHEN e IN ({_list(sp.ENTE)}) THEN b || 'ente'
  WHEN e = 'mente' THEN CASE WHEN {_ends('b', 'ante', 'able', 'ible')} AND length(b) - 4 >= p2 THEN left(b, -4) ELSE b END
  WHEN e IN ({_list(sp.IDAD)}) THEN CASE WHEN b LIKE '%abil' THEN {_less('abil')} ELSE {_less('ic', 'iv')} END ELSE {_less('at')} END AS one FROM {n}_f),
{n}_h AS (SELECT *, {end('substr(x, pv + 1)', sp.Y_VERBS)} AS y, {end('substr(x, pv + 1)', sp.VERBS + sp.GU_VERBS)} AS e FROM {n}_g),
{n}_i AS (SELECT *, y <> '' AND substr(x, 1, length(x) - length(y)) LIKE '%u' AS is_y, substr(x, 1, length(x) - length(e)) AS b FROM {n}_h),
{n}_j AS (SELECT w, pv, CASE WHEN one IS NOT NULL THEN one WHEN is_y THEN substr(x, 1, length(x) - length(y)) WHEN e IN ({_list(sp.GU_VERBS)}) AND b LIKE '%gu' THEN left(b, -1) ELSE b END AS x FROM {n}_i),
{n}_k AS (SELECT *, {end('x', sp.RESIDUAL)} AS e FROM {n}_j), {n}_l AS (SELECT *, substr(x, 1, length(x) - length(e)) AS b, e <> '' AND length(x) - length(e) >= pv AS cut FROM {n}_k),
{n} AS (SELECT w, translate(CASE WHEN NOT cut THEN x WHEN e IN ('e', 'é') AND b LIKE '%gu' AND length(b) - 1 >= pv THEN left(b, -1) ELSE b END, 'áéíóú', 'aeiou') AS term FROM {n}_l)"""


def lexical_sql(queries: str, chunks: str) -> str:
    """CTEs up to lx(q, d, r) for tables queries(q, text) and chunks(d, text) of one chunk a document; score is r / (r + 1)."""
    stop = _list(sp.STOPWORDS)
    return f"""qw AS (SELECT q, unnest(list_slice(list_filter(w, lambda x, i: list_position(w, x) = i), 1, 40)) AS w FROM (SELECT q, regexp_extract_all(lower(text), '[a-záéíóúñü0-9]{{3,}}') AS w FROM {queries})),
cw AS (SELECT d, w, count(*) AS n FROM (SELECT d, unnest(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}]+')) AS w FROM {chunks}) WHERE w NOT IN ({stop}) GROUP BY ALL),
ws AS (SELECT w FROM cw UNION SELECT w FROM qw), {stems_sql('ws')},
lx AS (SELECT q, d, sum(n) * 0.1::DOUBLE AS r FROM (SELECT DISTINCT q, term FROM qw JOIN stems USING (w) WHERE w NOT IN ({stop})) JOIN (SELECT d, term, n FROM cw JOIN stems USING (w)) USING (term) GROUP BY ALL)"""
