"""SQL for the queries of this folder that SQL can express."""

from __future__ import annotations

from .mixing import LEVELS, Plan


def _weight(named: dict[str, float], level: str, other: float) -> str:
    cases = " ".join(f"WHEN '{k}' THEN {v}::DOUBLE" for k, v in named.items())
    return f"CASE {level} {cases} ELSE {other}::DOUBLE END" if cases else f"{other}::DOUBLE"


def mixing_sql(plan: Plan) -> str:
    """The rows of mixing.selection() over documents."""
    out = [f"""rows AS (SELECT * FROM (SELECT doc_id, coalesce('d' || (CAST(nullif(regexp_extract(source, '([0-9]{{1,9}})$', 1), '') AS INT) % 3), 'none') AS domain, coalesce(lang, 'none') AS lang, coalesce(source, 'none') AS source,
  len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS n FROM documents) WHERE n > 0)""", f"leaves AS (SELECT domain, lang, source, sum(n) AS tokens, sum(n) * {plan.epochs} AS cap FROM rows GROUP BY ALL)"]
    for depth, level in enumerate(LEVELS):
        keys, parent = ", ".join(LEVELS[: depth + 1]), ", ".join(LEVELS[:depth])
        w = f"PARTITION BY {parent or '1'}"
        budget = f"JOIN b{depth - 1} USING ({parent})" if depth else f", (SELECT CAST(floor(sum(tokens) * {plan.share}::DOUBLE) AS BIGINT) AS budget FROM leaves)"
        out += [
            f"n{depth} AS (SELECT *, {_weight(getattr(plan, level), level, plan.other)} AS weight FROM (SELECT {keys}, sum(cap) AS cap FROM leaves GROUP BY {keys}) {budget})",
            f"f{depth} AS (SELECT *, (budget - (sum(cap) OVER o - cap)) * weight >= cap * (sum(weight) OVER ({w}) - (sum(weight) OVER o - weight)) AS complete FROM n{depth} WHERE weight > 0 WINDOW o AS ({w} ORDER BY cap / weight, {level}))",
            f"e{depth} AS (SELECT *, CASE WHEN complete THEN cap::DOUBLE ELSE (budget - sum(CASE WHEN complete THEN cap ELSE 0 END) OVER ({w})) * weight / sum(CASE WHEN complete THEN 0 ELSE weight END) OVER ({w}) END AS exact FROM f{depth})",
            f"g{depth} AS (SELECT *, CAST(least(floor(exact), cap) AS BIGINT) AS base, sum(cap) OVER ({w}) AS caps FROM e{depth})",
            f"h{depth} AS (SELECT *, least(budget, caps) - sum(base) OVER ({w}) AS spare, row_number() OVER ({w} ORDER BY base >= cap, round(exact - base, 6) DESC, {level}) AS place FROM g{depth})",
            f"b{depth} AS (SELECT {keys}, base + CASE WHEN place <= spare AND base < cap THEN 1 ELSE 0 END AS budget FROM h{depth})",
        ]
    out += [
        "q AS (SELECT domain, lang, source, CAST(budget // tokens AS INT) AS whole, budget % tokens AS rest FROM leaves JOIN b2 USING (domain, lang, source))",
        f"r AS (SELECT *, md5('{plan.seed}:' || whole || ':' || coalesce(CAST(doc_id AS VARCHAR), 'none')) AS o FROM rows JOIN q USING (domain, lang, source))",
        "s AS (SELECT *, sum(n) OVER (PARTITION BY domain, lang, source ORDER BY o, doc_id, n ROWS UNBOUNDED PRECEDING) - n AS start FROM r)",
        "t AS (SELECT *, CAST(least(n, greatest(0, rest - start)) AS BIGINT) AS take FROM s)",
    ]
    return "WITH " + ",\n".join(out) + """
SELECT doc_id, domain, lang, source, whole AS epoch, n AS n_tokens, take AS take_tokens FROM t WHERE take > 0
UNION ALL SELECT doc_id, domain, lang, source, unnest(range(0, whole))::INT, n, n FROM r WHERE whole > 0"""


OP7 = mixing_sql(Plan())

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP11 = f"""WITH pieces AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array({_LOWER}, '[.,;:!?\\x0A-\\x0D]')) AS piece FROM documents),
lists AS (SELECT lang, regexp_extract_all(piece, '[^\\x20\\x09]+') AS w FROM pieces),
totals AS (SELECT lang, sum(len(w))::BIGINT AS n FROM lists GROUP BY lang),
grams AS (SELECT lang, unnest(list_concat(w, list_concat([w[i] || ' ' || w[i + 1] FOR i IN range(1, len(w))], [w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] FOR i IN range(1, len(w) - 1)]))) AS phrase FROM lists),
counted AS (SELECT lang, phrase, count(*) AS f FROM grams GROUP BY ALL HAVING count(*) >= 10),
candidates AS (SELECT lang, phrase, f AS a, string_split(phrase, ' ') AS s FROM counted WHERE phrase LIKE '% %'),
cuts AS (SELECT lang, phrase, a, k, array_to_string(s[1:k], ' ') AS head, array_to_string(s[k + 1:], ' ') AS rest FROM (SELECT *, unnest(range(1, len(s))) AS k FROM candidates)),
scored AS (SELECT c.lang, c.phrase, a, k, h.f AS l, t.f AS r, (1000000::HUGEINT * a * a) // (h.f::HUGEINT * t.f) AS score FROM cuts c JOIN counted h ON h.lang = c.lang AND h.phrase = head JOIN counted t ON t.lang = c.lang AND t.phrase = rest),
lowest AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
longer AS (SELECT lang, phrase, max(a) AS longer FROM (SELECT lang, a, unnest([s[1] || ' ' || s[2], s[2] || ' ' || s[3]]) AS phrase FROM candidates WHERE len(s) = 3) GROUP BY ALL),
ranked AS (SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score::BIGINT AS score
  FROM lowest LEFT JOIN longer USING (lang, phrase) JOIN totals USING (lang) WHERE longer IS NULL OR 100 * longer < 50 * a)
SELECT * FROM ranked WHERE rank <= 2000"""

_TERMS = f"regexp_extract_all({_LOWER}, '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')"
OP12 = f"""WITH d AS (SELECT doc_id, {_TERMS} AS w FROM documents),
s AS (SELECT count(*) FILTER (WHERE len(w) > 0)::BIGINT AS N_, sum(len(w))::BIGINT AS L_ FROM d),
tf AS (SELECT doc_id, n, term, count(*)::BIGINT AS tf FROM (SELECT doc_id, len(w)::BIGINT AS n, unnest(w) AS term FROM d) GROUP BY ALL),
df AS (SELECT term, count(*)::BIGINT AS df FROM tf GROUP BY term),
q AS (SELECT item_id, term, count(*)::BIGINT AS times FROM (SELECT item_id, unnest({_TERMS}) AS term FROM benchmark) GROUP BY ALL),
w AS (SELECT item_id, term, times * floor(1000 * ln((2 * N_ + 2)::DOUBLE / (2 * df + 1)::DOUBLE))::BIGINT AS weight FROM q JOIN df USING (term), s),
scored AS (SELECT item_id, doc_id, sum(weight * ((1000000000 * tf) // (1000 * tf + 12 * (100 - 25 + ((25 * n * N_) // L_)))))::BIGINT AS score FROM w JOIN tf USING (term), s GROUP BY ALL)
SELECT item_id, rank::INT AS rank, doc_id, score FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM scored WHERE score > 0) WHERE rank <= 20"""

OP13 = """WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
windows AS (SELECT doc_id, i, md5(array_to_string(w[i:i + 49], ' ')) AS h FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM d)),
firsts AS (SELECT h, min(doc_id) AS first FROM windows GROUP BY h),
gone AS (SELECT DISTINCT doc_id, i + j AS place FROM (SELECT doc_id, i, unnest(range(0, 50)) AS j FROM windows JOIN firsts USING (h) WHERE first < doc_id)),
places AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS place FROM d),
kept AS (SELECT doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY place) AS k FROM places ANTI JOIN gone USING (doc_id, place) GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(k, '')) AS kept_sha256 FROM d LEFT JOIN kept USING (doc_id)"""
