"""Text functions as column expressions: folding, keys, addresses, numbers, trigrams, chunks."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

def _marked() -> tuple[str, str]:
    """Latin letters that a base letter and marks make up, and their base letters."""
    pairs = []
    for c in map(chr, [*range(0xC0, 0x250), *range(0x1E00, 0x1F00)]):
        base = "".join(x for x in unicodedata.normalize("NFKD", c) if not unicodedata.combining(x))
        if base != c and len(base) == 1:
            pairs.append((c, base))
    return "".join(c for c, _ in pairs), "".join(b for _, b in pairs)


MARKED, PLAIN_ = _marked()

# Street words and titles that addresses abbreviate.
ABBREVIATIONS = {"AV": "AVENIDA", "AVDA": "AVENIDA", "AVE": "AVENIDA", "GRAL": "GENERAL", "PJE": "PASAJE", "DR": "DOCTOR", "DRA": "DOCTORA", "PTE": "PRESIDENTE", "STA": "SANTA", "STO": "SANTO", "CNEL": "CORONEL", "ING": "INGENIERO", "ALM": "ALMIRANTE", "TTE": "TENIENTE", "BLVD": "BOULEVARD", "BV": "BOULEVARD"}


def fold(text: Column) -> Column:
    """Without the marks of Latin letters."""
    return F.translate(text, MARKED, PLAIN_)


def key(text: Column) -> Column:
    """Upper case, folded, only letters, digits and single spaces."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.upper(fold(text)), "[^A-Z0-9 ]", " "), " +", " "))


def _joined(text: Column) -> Column:
    return F.regexp_replace(text, r"([0-9])[.]([0-9]{3})(?![0-9])", "$1$2")


def address_key(text: Column) -> Column:
    """key() with thousands joined (1.400 is 1400) and without the word AL."""
    return F.array_join(F.filter(F.split(key(_joined(text)), " "), lambda w: w != "AL"), " ")


def address_parts(text: Column) -> dict[str, Column]:
    """normal, street, number, unit and approximate of an address of free text.

    Abbreviations are written out. A unit is digits, a degree sign and letters (4°B), and no part
    of the rest. `AL 2200` is an approximate number; else the first number of up to five digits counts.
    """
    flat = F.trim(F.regexp_replace(F.replace(F.replace(F.upper(fold(text)), F.lit(","), F.lit(" ")), F.lit("."), F.lit(". ")), r"\s+", " "))
    unit_pattern = r"\b([0-9]{1,3})\s*[°ºo]\s*([A-Z]{1,3})\b"
    unit = F.nullif(F.concat(F.regexp_extract(flat, unit_pattern, 1), F.regexp_extract(flat, unit_pattern, 2)), F.lit(""))
    rest = F.trim(F.regexp_replace(flat, unit_pattern, " "))
    full = F.create_map(*[F.lit(x) for pair in ABBREVIATIONS.items() for x in pair])
    bare = F.filter(F.transform(F.split(rest, r"\s+"), lambda w: F.regexp_replace(w, r"[.]+$", "")), lambda w: w != "")
    normal = F.array_join(F.transform(bare, lambda w: F.coalesce(F.element_at(full, w), w)), " ")
    after_al, first = r"^(.*?)\bAL\s+([0-9]{1,5})\b", r"^(.*?)\b([0-9]{1,5})\b"
    approximate = normal.rlike(after_al)
    pick = lambda g: F.when(approximate, F.regexp_extract(normal, after_al, g)).otherwise(F.regexp_extract(normal, first, g))
    number = F.nullif(pick(2), F.lit(""))
    street_ = F.nullif(F.when(number.isNull(), normal).otherwise(F.trim(pick(1))), F.lit(""))
    return {"normal": normal, "street": street_, "number": number, "unit": unit, "approximate": approximate}


def block_key(text: Column) -> Column:
    """Street and hundred of the number; without a number the street alone."""
    parts = address_parts(text)
    hundred = (F.floor(parts["number"].cast("int") / 100) * 100).cast("string")
    return F.concat_ws(" ", F.coalesce(address_key(parts["street"]), F.lit("")), hundred)


def street_of(block: Column) -> Column:
    """A block key without its number."""
    return F.trim(F.regexp_replace(block, r" ?[0-9]+$", ""))


def floor_and_unit(text: Column) -> tuple[Column, Column]:
    """Floor and unit as text: 4°B, 9°08, `Piso 5`, `7° Piso`, Depto/Departamento/Dpto/Unidad/UF C, `Piso "A"`; null where unsaid."""
    flat = F.trim(F.regexp_replace(F.upper(fold(text)), r"\s+", " "))
    pick = lambda p, g=1: F.nullif(F.regexp_extract(flat, p, g), F.lit(""))
    degree = address_parts(text)["unit"]
    twice = r"\b([0-9]{1,3})\s*[°º]\s*([0-9]{1,3})\b"
    floor = F.coalesce(pick(r"\bPISO\s+([0-9]{1,3})\b"), pick(r"\b([0-9]{1,3})\s*[°º]\s*PISO\b"))
    unit = F.coalesce(pick(r"\b(?:DEPTO|DEPARTAMENTO|DPTO|UNIDAD|UF)\s*[.]?\s*([A-Z0-9]{1,4})\b"), pick(r"PISO\s*[\"'“”]([A-Z0-9]{1,4})[\"'“”]"))
    own = lambda p: F.nullif(F.regexp_extract(degree, p, 1), F.lit(""))
    by = lambda a, b, c: F.when(degree.isNotNull(), a).when(flat.rlike(twice), b).otherwise(c)
    return by(own("^([0-9]*)"), pick(twice, 1), floor), by(own("^[0-9]*(.*)$"), pick(twice, 2), unit)


def whole_unit(text: Column) -> tuple[Column, Column]:
    """Floor and unit together (null where neither is said), and whether it names a flat and not only a floor."""
    floor, unit = floor_and_unit(text)
    return F.nullif(F.concat(F.coalesce(floor, F.lit("")), F.coalesce(unit, F.lit(""))), F.lit("")), unit.isNotNull()


def same_unit(a: Column, b: Column) -> Column:
    """True, false, or null when either is unknown."""
    return a == b


def trigrams(text: Column) -> Column:
    """Distinct three-character pieces of the text with two spaces before and one after it."""
    padded = F.concat(F.lit("  "), text, F.lit(" "))
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(padded) - 2), lambda i: F.substring(padded, i, F.lit(3))))


def jaccard(a: Column, b: Column) -> Column:
    return F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b))


def tokens(text: Column) -> Column:
    """Distinct folded words of three characters or more."""
    return F.array_distinct(F.filter(F.split(F.lower(key(text)), " "), lambda w: F.length(w) >= 3))


def number(text: Column) -> Column:
    """1.234.567,8 and 1234.5: a comma is decimal, dots are thousands only in groups of three; stops at the end go."""
    return _read(_bare(text))


def _bare(text: Column) -> Column:
    return F.regexp_replace(F.trim(text), "[.,]+$", "")


def _read(t: Column) -> Column:
    plain = F.when(t.contains(","), F.replace(F.replace(t, F.lit("."), F.lit("")), F.lit(","), F.lit("."))).when(t.rlike(r"^[0-9]+([.][0-9]{3})+$"), F.replace(t, F.lit("."), F.lit(""))).otherwise(t)
    return F.when(t.rlike("^[0-9]"), plain.try_cast("double"))


def numbers(text: Column) -> Column:
    """All numbers of a text, in order."""
    found = F.regexp_extract_all(text, F.lit(r"[0-9]+(?:[.,][0-9]+)*"), F.lit(0))
    return F.filter(F.transform(found, _read), lambda x: x.isNotNull())  # what is found ends in a digit


def orphans(said: Column, allowed: Column, share: float = 0.001, least: float = 0.5) -> Column:
    """Numbers that nothing allowed explains: no whole number up to 100, no year, none within tolerance."""
    free = lambda n: ((n == F.floor(n)) & (n <= 100)) | ((n == F.floor(n)) & n.between(1900, 2100))
    return F.filter(said, lambda n: ~free(n) & ~F.exists(allowed, lambda p: F.abs(n - p) <= F.greatest(F.abs(p) * share, F.lit(least))))


def normal(text: Column) -> Column:
    """Lower case, folded, single spaces: how cites are compared."""
    return F.trim(F.regexp_replace(F.lower(fold(text)), r"\s+", " "))


def citation_confidence(value: Column, cite: Column, text: Column) -> Column:
    """1.0 for a cite found in the text, 0.4 for none, 0.0 for a false one, null without a value."""
    return F.when(value.isNull(), F.lit(None)).when(F.coalesce(F.trim(cite), F.lit("")) == "", 0.4).when(F.contains(normal(text), normal(cite)), 1.0).otherwise(0.0)


def mean_confidence(confidences: Column) -> Column:
    """Mean of the known confidences with two digits (half to even), null without any."""
    known = F.filter(confidences, lambda c: c.isNotNull())
    return F.bround(F.try_divide(F.aggregate(known, F.lit(0.0), lambda s, c: s + c), F.size(known)), 2)


def json_numbers(data: Column) -> Column:
    """All numbers of a JSON text: numeric leaves as they are, those in string leaves as number() reads them; keys do not count."""
    quoted = r'"[^"\\]*+(?:\\.[^"\\]*+)*+"'  # possessive: neither backtracking nor recursion on long texts
    values = F.filter(F.regexp_extract_all(data, F.lit(quoted + r"\s*:|(" + quoted + ")"), F.lit(1)), lambda v: v != "")
    # Spark's own reader undoes the escapes of all texts at once; their digits must not count.
    lenient = {"allowUnquotedControlChars": "true", "allowBackslashEscapingAnyCharacter": "true"}
    texts = F.array_join(F.from_json(F.concat(F.lit("["), F.array_join(values, ","), F.lit("]")), "array<string>", lenient), " ; ")
    bare = F.regexp_replace(data, quoted, " ")
    leaves = F.transform(F.regexp_extract_all(bare, F.lit(r"-?[0-9]+(?:[.][0-9]+)?(?:[eE][-+]?[0-9]+)?"), F.lit(0)), lambda x: x.try_cast("double"))
    return F.concat(leaves, F.coalesce(numbers(texts), F.array().cast("array<double>")))


# What a report says about money, as paths of its JSON.
MONEY_OBJECTS, MONEY_FIELD, DISPERSION = ["$.valuacion.precio_publicacion_sugerido", "$.valuacion.rango_de_cierre_esperado"], "$.valuacion.usd_por_m2", "$.valuacion.dispersion"


def money_figures(data: Column) -> Column:
    """The amounts of a report's JSON: suggested price, closing range, price for a square metre."""
    objects = [F.coalesce(F.map_values(F.from_json(F.get_json_object(data, p), "map<string,string>")), F.array().cast("array<string>")) for p in MONEY_OBJECTS]
    every = F.concat(*objects, F.array(F.get_json_object(data, MONEY_FIELD)))
    return F.filter(F.transform(F.transform(every, _bare), _read), lambda x: x.isNotNull())


def allowed_numbers(data: Column) -> Column:
    """What a text about a report may say: every number of its JSON, the dispersion in per cent, amounts in thousands."""
    per_cent = F.array_compact(F.array(number(F.get_json_object(data, DISPERSION)) * 100))
    return F.concat(json_numbers(data), per_cent, F.transform(money_figures(data), lambda v: F.bround(v / 1000, 1)))


# Abbreviations whose full stop ends no sentence.
NO_END = ["av", "avda", "dr", "dra", "sr", "sra", "gral", "pte", "amb", "dpto", "dto", "depto", "cdad", "esq", "n", "nro", "ing", "arq", "cel", "tel", "aprox"]


def sentences(text: Column) -> Column:
    """Split at white space after . ! ? or an ellipsis where a capital, digit or opening mark follows, at empty lines
    and at line breaks before text; white space in a sentence is one space."""
    guarded = F.regexp_replace(text, r"(?iU)\b(" + "|".join(NO_END) + r")\.", "$1\u2024")
    parts = F.split(guarded, r"(?<=[.!?…])(?U:\s)+(?=[A-ZÁÉÍÓÚÑ¿¡]|(?U:\d))|\n{2,}|\n(?=(?U:\S))")
    flat = lambda s: F.trim(F.regexp_replace(F.replace(s, F.lit("\u2024"), F.lit(".")), r"(?U)\s+", " "))
    return F.filter(F.transform(parts, flat), lambda s: s != "")


def words(text: Column) -> Column:
    """The words of a text between white space; an empty text has none."""
    return F.filter(F.split(text, r"(?U)\s+"), lambda w: w != "")


def _once(value: Column, use) -> Column:  # noqa: ANN001
    """use(value) with the value computed once, however often use names it."""
    return F.transform(F.array(value), use)[0]


def window_chunks(words: Column, size: int, overlap: int) -> Column:
    """Windows of size words that overlap, until the end is covered."""
    step = max(1, size - overlap)

    def cut(w: Column) -> Column:
        count = F.greatest(F.lit(1), F.ceil((F.size(w) - size) / step) + 1).cast("int")
        return F.transform(F.sequence(F.lit(0), count - 1), lambda i: F.array_join(F.slice(w, i * step + 1, F.lit(size)), " "))

    return _once(words, cut)


def packed_chunks(parts: Column, target: int, most: int | None = None, base: int = 0) -> Column:
    """Sentences packed in order into chunks of at most target words, of which `base` go to a header.

    With `most`, longer sentences are first cut into pieces of so many words, and a chunk
    begins with the last piece of the one before unless that takes it over `most` words; no
    chunk is longer. Without, a longer sentence stands alone and nothing overlaps.
    """
    # Each sentence's words are counted once.
    sized = F.transform(parts, lambda s: F.struct(s.alias("s"), F.size(F.split(s, r"(?U)\s+")).alias("n")))
    if most is not None:
        room = most - base

        def pieces(x: Column) -> Column:
            cut = lambda w: F.transform(F.sequence(F.lit(0), F.floor((x["n"] - 1) / room).cast("int")), lambda i: F.struct(F.array_join(F.slice(w, i * room + 1, F.lit(room)), " ").alias("s"), F.least(F.lit(room), x["n"] - i * room).cast("int").alias("n")))
            return F.when(x["n"] <= room, F.array(x)).otherwise(_once(F.split(x["s"], r"(?U)\s+"), cut))

        sized = F.flatten(F.transform(sized, pieces))
    none = F.struct(F.lit("").alias("s"), F.lit(0).alias("n"))
    start = F.struct(F.array().cast("array<string>").alias("done"), F.array().cast("array<string>").alias("open"), F.lit(0).alias("n"), none.alias("last"))

    def add(acc: Column, x: Column) -> Column:
        fits = (acc["n"] == 0) | (base + acc["n"] + x["n"] <= target)
        again = F.lit(False) if most is None else base + acc["last"]["n"] + x["n"] <= most
        own = F.array(x["s"])
        return F.struct(
            F.when(fits, acc["done"]).otherwise(F.concat(acc["done"], F.array(F.array_join(acc["open"], " ")))).alias("done"),
            F.when(acc["n"] == 0, own).when(fits, F.concat(acc["open"], own)).when(again, F.array(acc["last"]["s"], x["s"])).otherwise(own).alias("open"),
            F.when(fits, acc["n"] + x["n"]).when(again, acc["last"]["n"] + x["n"]).otherwise(x["n"]).alias("n"),
            x.alias("last"),
        )

    end = lambda acc: F.when(acc["n"] == 0, acc["done"]).otherwise(F.concat(acc["done"], F.array(F.array_join(acc["open"], " "))))
    return F.aggregate(sized, start, add, end)


def truncated(parts: Column, most: int, base: int = 0) -> Column:
    """Leading sentences while they and a header of `base` words fit into most words; the first always stays."""
    sized = F.transform(parts, lambda s: F.struct(s.alias("s"), F.size(F.split(s, r"(?U)\s+")).alias("n")))
    start = F.struct(F.array().cast("array<string>").alias("held"), F.lit(base).alias("n"), F.lit(True).alias("open"))

    def add(acc: Column, x: Column) -> Column:
        fits = acc["open"] & ((F.size(acc["held"]) == 0) | (acc["n"] + x["n"] <= most))
        return F.struct(F.when(fits, F.concat(acc["held"], F.array(x["s"]))).otherwise(acc["held"]).alias("held"), F.when(fits, acc["n"] + x["n"]).otherwise(acc["n"]).alias("n"), fits.alias("open"))

    return F.aggregate(sized, start, add, lambda acc: F.array_join(acc["held"], " "))


def escaped(text: Column) -> Column:
    out = text
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def money(value: Column) -> Column:
    """1234567.5 as 1.234.568 (thousands with dots, whole, half to even)."""
    return F.translate(F.format_number(F.bround(value, 0), 0), ",", ".")


def wrapped(text: Column) -> Column:
    """Text of others between marks; a closing mark inside it is written out."""
    return F.concat(F.lit("<contenido_externo>\n"), F.replace(F.coalesce(text, F.lit("")), F.lit("</contenido_externo>"), F.lit("&lt;/contenido_externo&gt;")), F.lit("\n</contenido_externo>"))


# Cues of reasons to leave a listing out, and of where a field's answer stands.
REASON_CUES = {
    "en_pozo_o_construccion": r"en\s+pozo|en\s+construcci[oó]n|entrega\s+(?:en\s+)?(?:20\d\d|\w+\s+20\d\d)|departamento\s+modelo|pr[oó]xim[ao]\s+lanzamiento|avance\s+de\s+obra|cuotas?\s+(?:en\s+)?pesos|fideicomiso|desde\s+el\s+pozo",
    "permuta_o_financiacion": r"permut|parte\s+de\s+pago|financia|cuotas|acepta(?:mos)?\s+propiedad",
    "precio_promocional": r"remate|subasta|urge\s+(?:la\s+)?venta|liquidaci[oó]n|oportunidad\s+[uú]nica",
    "tipologia_distinta": r"\blocal\b|\boficina\b|\bcochera\s+sola\b|\blote\b|\bgalp[oó]n\b",
}
FIELD_CUES = {
    "floor_number": r"\d{1,2}\s*(?:°|º|ro|do|to|mo|vo)?\s*piso|piso\s*\d{1,2}|planta\s+baja|\bPB\b",
    "orientation": r"contrafrente|al\s+frente|\bfrente\b|lateral|interno|contra\s*frente",
    "has_elevator": r"ascensor(?:es)?|sin\s+ascensor",
    "age_years": r"(?:antig[uü]edad|estrenar|a[nñ]os\s+de\s+construid|construido\s+en)\D{0,20}\d{0,4}",
    "condition": r"a\s+estrenar|refaccionar|reciclad|excelente\s+estado|muy\s+buen\s+estado|impecable",
    "parking_spaces": r"cochera|garage|garaje|estacionamiento",
}


def suggested_reasons(text: Column) -> Column:
    """Names of the cues for leaving out that a text has, in order."""
    return F.array_compact(F.array(*[F.when(text.rlike("(?i)" + p), F.lit(name)) for name, p in REASON_CUES.items()]))


def marked_places(text: Column, pattern: str, use) -> Column:  # noqa: ANN001
    """use(before, match, after) of every match of a pattern (without groups of its own that matter) in a text, in order."""
    pieces = F.split(F.regexp_replace(text, "(" + pattern + ")", "\u0001$1\u0002"), "\u0001")
    clean = lambda parts: F.replace(F.array_join(parts, ""), F.lit("\u0002"), F.lit(""))

    def places(p: Column) -> Column:
        def one(i: Column) -> Column:
            own = F.split(F.element_at(p, i), "\u0002")
            return use(clean(F.slice(p, 1, i - 1)), own[0], F.concat(own[1], clean(F.slice(p, i + 1, F.size(p)))))

        return F.when(F.size(p) > 1, F.transform(F.sequence(F.lit(2), F.size(p)), one)).otherwise(F.array())

    return _once(pieces, places)


def cue_fragments(text: Column, most: int = 3, around: int = 45) -> Column:
    """A map from each field to up to `most` distinct places of its cues with what stands around them; fields without one are absent."""
    flat = F.trim(F.regexp_replace(text, r"\s+", " "))
    near = lambda before, match, after: F.trim(F.concat(F.right(before, F.lit(around)), match, F.left(after, F.lit(around))))
    found = [(f, F.slice(F.array_distinct(marked_places(flat, "(?i)(?:" + p + ")", near)), 1, most)) for f, p in FIELD_CUES.items()]
    pairs = F.array(*[F.struct(F.lit(f).alias("k"), v.alias("v")) for f, v in found])
    return F.map_from_entries(F.filter(pairs, lambda e: F.size(e["v"]) > 0))


def fragments(markdown: Column) -> Column:
    """Parts of a text by its headings, each with its heading; what stands before the first has none."""
    parts = F.split(F.concat(F.lit("\n"), markdown), r"\n(?=#{1,6} )")
    return F.filter(F.transform(parts, lambda p: F.regexp_replace(p, r"^\s+|\s+$", "")), lambda p: p != "")


# How a query text says a condition and an orientation.
CONDITION_WORDS = {"a_estrenar": "a estrenar", "excelente": "excelente estado", "muy_bueno": "muy buen estado", "bueno": "buen estado", "a_refaccionar": "a refaccionar"}
ORIENTATION_WORDS = {"frente": "al frente", "contrafrente": "al contrafrente", "lateral": "lateral", "interno": "interno"}


def header(kind: Column, rooms: Column, surface: Column, area: Column, floor: Column | None = None, price: Column | None = None, condition: Column | None = None) -> Column:
    """Known facts in one line, joined by a middle dot; the unit price is rounded to hundreds, half to even."""
    none = F.lit(None)
    floor, price, condition = (none if c is None else c for c in (floor, price, condition))
    name = F.coalesce(F.nullif(kind, F.lit("")), F.lit("propiedad"))
    unit = F.bround(F.when(surface > 0, price / surface) / 100, 0) * 100
    return F.concat_ws(
        " · ",
        F.concat(F.upper(F.substring(name, 1, 1)), F.lower(F.substring(name, 2, 1_000_000))),
        F.when(rooms == 1, "monoambiente").when(rooms != 0, F.concat(rooms.cast("string"), F.lit(" ambientes"))),
        F.when(surface > 0, F.concat(F.bround(surface, 0).cast("long").cast("string"), F.lit(" m²"))),
        F.nullif(area, F.lit("")),
        F.when(floor == 0, "planta baja").when(floor.isNotNull(), F.concat(F.lit("piso "), floor.cast("string"))),
        F.nullif(F.replace(condition.cast("string"), F.lit("_"), F.lit(" ")), F.lit("")),
        F.when((price != 0) & (surface > 0), F.concat(F.lit("USD "), F.translate(F.format_number(unit, 0), ",", "."), F.lit("/m²"))),
    )


def query_text(kind: Column, rooms: Column, surface: Column, area: Column, floor: Column, condition: Column, orientation: Column, elevator: Column, age: Column, parking: Column, amenities: Column, notes: Column) -> Column:
    """What a subject is searched by: its header, what a listing would say in prose, and its notes (1,500 characters)."""
    said = lambda v, words_: F.element_at(F.create_map(*[F.lit(x) for pair in words_.items() for x in pair]), v)
    prose = F.array_compact(F.array(
        said(condition, CONDITION_WORDS), said(orientation, ORIENTATION_WORDS),
        F.when(elevator, "con ascensor").when(~elevator, "sin ascensor"),
        F.when(age == 0, "a estrenar").when(age.isNotNull(), F.concat(age.cast("string"), F.lit(" años de antigüedad"))),
        F.when(parking > 0, "con cochera"),
        F.when(F.size(amenities) > 0, F.concat(F.lit("amenities: "), F.array_join(F.slice(amenities, 1, 6), ", "))),
    ))
    line = F.when(F.size(prose) > 0, F.concat(F.array_join(F.transform(prose, lambda p: F.concat(F.upper(F.substring(p, 1, 1)), F.substring(p, 2, 1_000_000))), ". "), F.lit(".")))
    return F.concat_ws("\n", header(kind, rooms, surface, area, floor, None, condition), line, F.nullif(F.substring(F.trim(notes), 1, 1500), F.lit("")))


def needs_review(confidences: Column) -> Column:
    """Any false cite (0.0) among the confidences."""
    return F.exists(confidences, lambda c: c == 0.0)


def applied(portal: Column, extracted: Column, confidence: Column, least: float = 0.70) -> Column:
    """The portal's fact, else the extracted one if it is sure enough."""
    return F.coalesce(portal, F.when(confidence >= least, extracted))
