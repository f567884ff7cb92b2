"""Stems against the sample vocabulary of the published rules and a plain version by string operations; the lexical mode by hand."""

import random

from pyspark.sql import functions as F

from plumbline.functions import spanish as sp
from plumbline.operators import retrieval

SAMPLES = """che che|checa chec|checar chec|cheque chequ|chequeo cheque|cheques chequ|chía chi|chiapaneca chiapanec|chica chic|chicharrones chicharron|torá tor|tórax torax|torcer torc|toreado tor|toreándolo tor|torear tor
torearlo tor|toreó tore|torero torer|tormenta torment|torneos torne|torreón torreon|tortura tortur|balcones balcon|balcón balcon|departamentos departament|departamento departament|luminosa lumin|luminosidad lumin
haciéndola hac|comprarlo compr|llegue lleg|tranquilamente tranquil|rápidamente rapid|construyendo constru|constituciones constitu|geología geolog|existencia existent|negativamente negat|habitación habit|habitaciones habit|2024 2024"""


def plain(w):
    vowel = lambda c: c in "aeiouáéíóúü"

    def after(start, first, second):
        i = start
        while i < len(w) and not first(w[i]):
            i += 1
        i += 1
        while i < len(w) and not second(w[i]):
            i += 1
        return i + 1 if i < len(w) else len(w)

    no = lambda c: not vowel(c)
    p1 = after(0, vowel, no)
    p2 = after(p1, vowel, no) if p1 < len(w) else len(w)
    pv = len(w)
    if len(w) >= 2:
        if no(w[1]):
            pv = next((i + 1 for i in range(2, len(w)) if vowel(w[i])), len(w))
        elif vowel(w[0]):
            pv = next((i + 1 for i in range(2, len(w)) if no(w[i])), len(w))
        elif len(w) >= 3:
            pv = 3
    longest = lambda t, ends: max((e for e in ends if t.endswith(e)), key=len, default="")

    def cut(t, ends, p):
        e = longest(t, ends)
        return t[: len(t) - len(e)] if e and len(t) - len(e) >= p else t

    e = longest(w, sp.PRONOUNS)
    if e:
        base = w[: -len(e)]
        v = longest(base, sp.BEFORE_PRONOUN)
        if v and len(base) - len(v) >= pv and (v != "yendo" or base.endswith("uyendo")):
            w = base[: -len(v)] + v.replace("é", "e").replace("á", "a").replace("í", "i")
    done = None
    e = longest(w, sp.STEP_1)
    if e:
        base = w[: -len(e)]
        if e == "amente":
            if len(base) >= p1:
                done = cut(base, ["iv"], p2)
                done = cut(done, ["at"], p2) if done != base else cut(base, ["os", "ic", "ad"], p2)
        elif len(base) >= p2:
            for group, act in (
                (sp.IN_R2, lambda b: b), (sp.AFTER_IC, lambda b: cut(b, ["ic"], p2)), (sp.LOG, lambda b: b + "log"), (sp.U, lambda b: b + "u"), (sp.ENTE, lambda b: b + "ente"),
                (["mente"], lambda b: cut(b, ["ante", "able", "ible"], p2)), (sp.IDAD, lambda b: cut(b, ["abil", "ic", "iv"], p2)), (sp.IVA, lambda b: cut(b, ["at"], p2)),
            ):
                if e in group:
                    done = act(base)
    if done is None:
        e = longest(w[pv:], sp.Y_VERBS)
        if e and w[: -len(e)].endswith("u"):
            done = w[: -len(e)]
        else:
            e = longest(w[pv:], sp.VERBS + sp.GU_VERBS)
            done = w[: len(w) - len(e)]
            if e in sp.GU_VERBS and done.endswith("gu"):
                done = done[:-1]
    w = done
    e = longest(w, sp.RESIDUAL)
    if e and len(w) - len(e) >= pv:
        w = w[: -len(e)]
        if e in ("e", "é") and w.endswith("gu") and len(w) - 1 >= pv:
            w = w[:-1]
    return w.translate(str.maketrans("áéíóú", "aeiou"))


def test_stems(spark):
    pairs = [tuple(p.split()) for p in SAMPLES.replace("\n", "|").split("|")]
    draw = random.Random(5)
    parts = sp.STEP_1 + sp.VERBS + sp.Y_VERBS + sp.GU_VERBS + sp.PRONOUNS + sp.BEFORE_PRONOUN + sp.RESIDUAL + ["ic", "at", "iv", "gu", "u", "b", "str", "ll", "ñ", "ü", "x1"]
    words = [w for w, _ in pairs] + ["", "a", "y", "ay", "sé"] + ["".join(draw.choices(parts, k=draw.randint(1, 4))) for _ in range(6000)]
    got = {r.w: r.stem for r in spark.createDataFrame([(w,) for w in words] + [(None,)], "w string").select("w", sp.stem(F.col("w")).alias("stem")).collect()}
    assert {w: got[w] for w, _ in pairs} == dict(pairs)
    assert got[None] is None
    assert {w: got[w] for w in words} == {w: plain(w) for w in words}


def test_stopwords():
    assert len(sp.STOPWORDS) == 313
    assert {"que", "con", "estábamos", "hubiésemos", "fuéramos", "tendríais", "sería", "tenidas"} <= set(sp.STOPWORDS)
    assert not {"casa", "informe", "balcón"} & set(sp.STOPWORDS)


def hits(spark, query, chunks, pairs=None):
    index = retrieval.postings(spark.createDataFrame(chunks, "d int, chunk int, text string"))
    queries = spark.createDataFrame([(1, query)], "q int, text string")
    return {r.d: round(r.score, 6) for r in retrieval.lexical_scores(queries, index, pairs).collect()}


def test_lexical_scores_by_hand(spark):
    score = lambda n: round(n * 0.1 / (n * 0.1 + 1), 6)
    chunks = [(7, 0, "con los que para una con con con"), (8, 0, "hermoso departamento con balcones"), (9, 0, "Balcón, balcón. BALCONES"), (9, 1, "frente"), (10, 0, None), (11, 0, "nada")]
    assert hits(spark, "departamento con balcon al frente de la calle", chunks) == {8: score(2), 9: score(3)}
    assert hits(spark, "con los que para", chunks) == {} and hits(spark, None, chunks) == {} and hits(spark, "", chunks) == {}
    # Two words with one stem are one term; a best chunk stands for its document.
    assert hits(spark, "balcón balcones frentes", chunks) == {8: score(1), 9: score(3)}
    # Forty words count, stopwords and repeats of a word among them or not.
    assert hits(spark, " ".join(f"zz{i:02d}" for i in range(40)) + " departamento", chunks) == {}
    assert hits(spark, "para " * 50 + "departamento", chunks) == {8: score(1)}
    pairs = spark.createDataFrame([(1, 8), (1, 11), (2, 9)], "q int, d int")
    assert hits(spark, "balcón", chunks, pairs) == {8: score(1)}


def test_postings_of_some_terms_are_those_of_all(spark):
    rng = random.Random(4)
    words = ["balcón", "Balcones", "balcon", "departamento", "departamentos", "frente", "para", "con", "luminosa", "2024", "zz"]
    chunks = spark.createDataFrame([(d, d % 3, " ".join(rng.choice(words) for _ in range(rng.randrange(30))) or None) for d in range(40)], "d int, chunk int, text string")
    terms = retrieval.query_terms(spark.createDataFrame([(1, "balcones y departamento"), (2, "luminosidad, balcón")], "q int, text string"))
    wanted = {r.term for r in terms.collect()}
    rows = lambda df: sorted((r.d, r.chunk, r.term, r.n) for r in df.collect())
    some = retrieval.postings(chunks, terms)
    assert rows(some) == [r for r in rows(retrieval.postings(chunks)) if r[2] in wanted] and rows(some)
    # Stems are taken above the grouping of distinct words: a plan that takes them of each word of a text is many times as slow.
    plan = some._jdf.queryExecution().optimizedPlan().toString()
    assert "LeftSemi" not in plan
