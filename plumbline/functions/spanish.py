"""Spanish words as search terms: stopwords, and stems by the published Snowball rules, as column functions.

A stem is found by regular expressions over whole columns; nothing leaves the JVM.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

V = "aeiouáéíóúü"

# The suffixes of the Snowball algorithm for Spanish, by step.
PRONOUNS = "me se sela selo selas selos la le lo las les los nos".split()
BEFORE_PRONOUN = "iéndo ándo ár ér ír iendo ando ar er ir yendo".split()
IN_R2 = "anza anzas ico ica icos icas ismo ismos able ables ible ibles ista istas oso osa osos osas amiento amientos imiento imientos".split()
AFTER_IC = "adora ador ación adoras adores aciones ante antes ancia ancias".split()
LOG, U, ENTE = ["logía", "logías"], ["ución", "uciones"], ["encia", "encias"]
IDAD, IVA = ["idad", "idades"], ["iva", "ivo", "ivas", "ivos"]
Y_VERBS = "ya ye yan yen yeron yendo yo yó yas yes yais yamos".split()
GU_VERBS = "en es éis emos".split()
VERBS = (
    "arían arías arán arás aríais aría aréis aríamos aremos ará aré erían erías erán erás eríais ería eréis eríamos eremos erá eré "
    "irían irías irán irás iríais iría iréis iríamos iremos irá iré aba ada ida ía ara iera ad ed id ase iese aste iste an aban ían aran ieran asen iesen "
    "aron ieron ado ido ando iendo ió ar er ir as abas adas idas ías aras ieras ases ieses ís áis abais íais arais ierais aseis ieseis asteis isteis "
    "ados idos amos ábamos íamos imos áramos iéramos iésemos ásemos"
).split()
RESIDUAL = "os a o á í ó e é".split()

# Stopwords that are no verbs.
PARTICLES = (
    "de la que el en y a los del se las por un para con no una su al lo como más pero sus le ya o este sí porque esta entre cuando muy sin sobre también me hasta hay "
    "donde quien desde todo nos durante todos uno les ni contra otros ese eso ante ellos e esto mí antes algunos qué unos yo otro otras otra él tanto esa estos mucho "
    "quienes nada muchos cual poco ella estas algunas algo nosotros mi mis tú te ti tu tus ellas nosotras vosotros vosotras os mío mía míos mías "
    "tuyo tuya tuyos tuyas suyo suya suyos suyas nuestro nuestra nuestros nuestras vuestro vuestra vuestros vuestras esos esas"
).split()


def _verb_stopwords() -> list[str]:
    """Forms of estar, haber, ser and tener (and participles of sentir, which the list has in place of those of ser), by tense."""
    forms = lambda stem, endings: [stem + e for e in endings.split()]
    present = "estar estoy estás está estamos estáis están esté estés estemos estéis estén estad he has ha hemos habéis han haya hayas hayamos hayáis hayan soy eres es somos sois son sea seas seamos seáis sean tengo tienes tiene tenemos tenéis tienen tenga tengas tengamos tengáis tengan tened"
    out = present.split()
    for stem in ("estar", "habr", "ser", "tendr"):  # future, conditional
        out += forms(stem, "é ás á emos éis án ía ías íamos íais ían")
    out += forms("est", "aba abas ábamos abais aban") + forms("hab", "ía ías íamos íais ían") + "era eras éramos erais eran".split() + forms("ten", "ía ías íamos íais ían")
    for stem in ("estuv", "hub", "tuv"):  # preterite
        out += forms(stem, "e iste o imos isteis ieron")
    out += forms("fu", "i iste e imos isteis eron")
    for stem in ("estuvi", "hubi", "fu", "tuvi"):  # past subjunctives
        out += forms(stem, "era eras éramos erais eran ese eses ésemos eseis esen")
    out += forms("est", "ando ado ada ados adas") + forms("hab", "iendo ido ida idos idas") + "sintiendo sentido sentida sentidos sentidas siente sentid".split() + forms("ten", "iendo ido ida idos idas")
    return out


STOPWORDS = sorted(set(PARTICLES + _verb_stopwords()))


def any_of(suffixes: list[str]) -> str:
    """Pattern of the longest of the suffixes that a text ends in: the leftmost match is the longest one."""
    return "(?:" + "|".join(suffixes) + ")$"


STEP_1 = IN_R2 + AFTER_IC + LOG + U + ENTE + IDAD + IVA + ["amente", "mente"]
R1 = f"^.*?[{V}][^{V}]"
R2 = f"^.*?[{V}][^{V}].*?[{V}][^{V}]"
RV = f"^(?:.[^{V}].*?[{V}]|[{V}][{V}].*?[^{V}]|[^{V}][{V}].)"


def _let(value: Column, then: Callable[[Column], Column]) -> Column:
    """then(value) with the value computed once; a filter on the result that is pushed down repeats it no further."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def _end(text: Column, suffixes: list[str]) -> Column:
    return F.regexp_extract(text, any_of(suffixes), 0)


def _less(text: Column, suffix: Column) -> Column:
    """text without its suffix."""
    return F.substring(text, F.lit(1), F.length(text) - F.length(suffix))


def _cut(text: Column, suffixes: list[str], region: Column) -> Column:
    """text without one of some suffixes of one length, if that lies in the region; else text."""
    n = len(suffixes[0])
    ends = F.lit(False)
    for s in suffixes:
        ends = ends | text.endswith(s)
    return F.when(ends & (F.length(text) - n >= region), F.substring(text, F.lit(1), F.length(text) - n)).otherwise(text)


def _without_pronoun(w: Column, pv: Column) -> Column:
    """Step 0: a pronoun after an infinitive or a gerund in RV goes, and so does the verb's accent."""

    def split(base: Column, verb: Column) -> Column:
        fits = (verb != "") & (F.length(base) - F.length(verb) >= pv) & ((verb != "yendo") | base.endswith("uyendo"))
        return F.when(fits, F.concat(_less(base, verb), F.translate(verb, "áéí", "aei"))).otherwise(w)

    return _let(_less(w, _end(w, PRONOUNS)), lambda base: _let(F.when(base != w, _end(base, BEFORE_PRONOUN)).otherwise(""), lambda verb: split(base, verb)))


def _without_suffix(w: Column, p1: Column, p2: Column) -> Column:
    """Step 1: the longest of the standard suffixes counts, whether it can be removed or not; null if none goes."""

    def removed(base: Column, end: Column) -> Column:
        iv = base.endswith("iv") & (F.length(base) - 2 >= p2)
        manner = F.when(iv, _cut(F.substring(base, F.lit(1), F.length(base) - 2), ["at"], p2)).otherwise(_cut(base, ["os", "ic", "ad"], p2))
        return (
            F.when(end == "", F.lit(None))
            .when(end == "amente", F.when(F.length(base) >= p1, manner))
            .when(F.length(base) < p2, F.lit(None))
            .when(end.isin(IN_R2), base)
            .when(end.isin(AFTER_IC), _cut(base, ["ic"], p2))
            .when(end.isin(LOG), F.concat(base, F.lit("log")))
            .when(end.isin(U), F.concat(base, F.lit("u")))
            .when(end.isin(ENTE), F.concat(base, F.lit("ente")))
            .when(end == "mente", _cut(base, ["ante", "able", "ible"], p2))
            .when(end.isin(IDAD), F.when(base.endswith("abil"), _cut(base, ["abil"], p2)).otherwise(_cut(base, ["ic", "iv"], p2)))
            .otherwise(_cut(base, ["at"], p2))
        )

    return _let(_end(w, STEP_1), lambda end: _let(_less(w, end), lambda base: removed(base, end)))


def _without_verb(w: Column, pv: Column) -> Column:
    """Step 2: verb endings within RV, those with y after a u first."""
    within = lambda suffixes: _end(F.substring(w, pv + 1, F.length(w)), suffixes)
    other = _let(within(VERBS + GU_VERBS), lambda end: _let(_less(w, end), lambda base: F.when(end.isin(GU_VERBS) & base.endswith("gu"), _less(base, F.lit("u"))).otherwise(base)))
    return _let(within(Y_VERBS), lambda end: F.when((end != "") & _less(w, end).endswith("u"), _less(w, end)).otherwise(other))


def _without_vowel(w: Column, pv: Column) -> Column:
    """Step 3: what is left of an ending's vowel, in RV, with the silent u of gue."""
    silent = lambda base, end: end.isin("e", "é") & base.endswith("gu") & (F.length(base) - 1 >= pv)
    rest = lambda base, end: F.when(F.length(base) < pv, w).when(silent(base, end), _less(base, F.lit("u"))).otherwise(base)
    return _let(_end(w, RESIDUAL), lambda end: F.when(end == "", w).otherwise(_let(_less(w, end), lambda base: rest(base, end))))


def stem(word: Column) -> Column:
    """The stem of a lower-case word; null stays null, and words of other letters mostly stay as they are."""
    region = lambda w, pattern: _let(F.length(F.regexp_extract(w, pattern, 0)), lambda n: F.when(n == 0, F.length(w)).otherwise(n))

    def of(w: Column, p1: Column, p2: Column, pv: Column) -> Column:
        parts = _let(_without_pronoun(w, pv), lambda a: _let(_without_suffix(a, p1, p2), lambda b: F.when(b.isNotNull(), b).otherwise(_without_verb(a, pv))))
        return F.translate(_let(parts, lambda c: _without_vowel(c, pv)), "áéíóú", "aeiou")

    start = F.struct(word.alias("w"), region(word, R1).alias("p1"), region(word, R2).alias("p2"), region(word, RV).alias("pv"))
    return _let(start, lambda s: of(s["w"], s["p1"], s["p2"], s["pv"]))
