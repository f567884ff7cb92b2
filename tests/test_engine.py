"""Hand-computed cases of the engine's operators."""

import json
import shutil

import pytest
from pyspark.sql import functions as F

from plumbline.functions import config, geo
from plumbline.functions import text as tx
from plumbline.operators import evaluation as ev
from plumbline.operators import changes, contracts, lookup, resolution, retrieval, valuation
from plumbline.plans import registry
from plumbline.sources import feeds
from plumbline.streaming import prices


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def comps(spark, unit_prices, **change):
    base = dict(price=None, currency="USD", surface=50.0, parking=0, condition=None, age_years=None, orientation=None, floor_number=None, has_elevator=None, amenities=[], days=10, manual=False)
    subject = dict(surface=50.0, parking=0, condition=None, age_years=None, orientation=None, floor_number=None, has_elevator=None, amenities=[], step=0, complete=1.0)
    rows = [{"k": 1, **base, "price": p * 50.0, **change, **{f"subject_{a}": b for a, b in subject.items()}} for p in unit_prices]
    types = "k int, price double, currency string, surface double, parking int, condition string, age_years int, orientation string, floor_number int, has_elevator boolean, amenities array<string>, days int, manual boolean, subject_surface double, subject_parking int, subject_condition string, subject_age_years int, subject_orientation string, subject_floor_number int, subject_has_elevator boolean, subject_amenities array<string>, subject_step int, subject_complete double"
    names = [c.split()[0] for c in types.split(", ")]
    return spark.createDataFrame([tuple(r[n] for n in names) for r in rows], types)


def test_equal_comparables_give_their_price(spark):
    r = valuation.value(comps(spark, [2000.0] * 12), ["k"]).first()
    assert (r.status, r.n_used, r.unit_price, r.value_mid, r.value_low, r.value_high) == ("ok", 12, 2000, 100000, 80000, 120000)
    assert r.closing_low == 85000 and r.closing_high == 95000 and r.confidence == "ALTA" and r.dispersion == 0


def test_pocos_comparables_and_trim_threshold(spark):
    r = valuation.value(comps(spark, [2000.0] * 4), ["k"]).first()
    assert r.status == "pocos_comparables" and r.value_mid is None
    assert valuation.value(comps(spark, [2000.0] * 6 + [3000.0]), ["k"]).first().n_used == 7
    assert valuation.value(comps(spark, [2000.0] * 7 + [3000.0]), ["k"]).first().n_used == 7


def test_cap_excludes_and_unknown_is_neutral(spark):
    rows = valuation.adjusted(comps(spark, [2000.0], condition="a_estrenar", floor_number=9, amenities=["PILETA", "gimnasio", "SUM"])).first()
    assert rows.reason == "ajuste_excede_el_tope" and abs(rows.coef - 1.15 * 1.04 * 1.05) < 1e-8
    assert valuation.adjusted(comps(spark, [2000.0])).first().coef == 1
    assert valuation.adjusted(comps(spark, [2000.0], floor_number=5)).first().coef == 1  # a lift is not known to be absent
    assert valuation.adjusted(comps(spark, [2000.0], floor_number=5, has_elevator=False)).first().coef == 0.88
    assert valuation.adjusted(comps(spark, [200.0])).first().reason == "usd_m2_fuera_de_rango"
    assert valuation.adjusted(comps(spark, [2000.0], currency="ARS")).first().reason == "sin_precio_o_superficie_en_usd"
    assert len(config.DEFAULT.method_version().split("+")[1]) == 12


def test_text_functions(spark):
    L = F.lit
    assert one(spark, tx.address_key(L("Av. Gral. Paz 1.400, al 5"))) == "AV GRAL PAZ 1400 5" and one(spark, tx.address_parts(L("Av. Gral. Paz 1400"))["normal"]) == "AVENIDA GENERAL PAZ 1400"
    assert one(spark, tx.block_key(L("AVENIDA PAZ 1432"))) == "AVENIDA PAZ 1400"
    f, u = tx.floor_and_unit(L("Paz 100 4°B"))
    assert (one(spark, f), one(spark, u)) == ("4", "B")
    assert [one(spark, tx.number(L(x))) for x in ("1.234.567,8", "1.234", "12.5", "7", "x")] == [1234567.8, 1234.0, 12.5, 7.0, None]
    assert one(spark, tx.jaccard(tx.trigrams(L("")), tx.trigrams(L("")))) == 1.0
    assert one(spark, tx.sentences(L("Av. Paz 3. Muy bueno!\nFin"))) == ["Av. Paz 3.", "Muy bueno!", "Fin"]
    assert one(spark, tx.packed_chunks(F.array(L("a b c"), L("d e"), L("f g h i j k"), L("l")), 5)) == ["a b c d e", "f g h i j k", "l"]
    assert one(spark, tx.window_chunks(F.split(L("1 2 3 4 5 6 7"), " "), 4, 1)) == ["1 2 3 4", "4 5 6 7"]
    assert one(spark, tx.orphans(tx.numbers(L("vale 120.500 en 2024, 3 ambientes, 99.999")), F.array(L(120490.0)))) == [99999.0]
    assert one(spark, tx.citation_confidence(L("x"), L("MUY  bueno"), L("es muy bueno"))) == 1.0
    assert one(spark, tx.escaped(L("<a>&"))) == "&lt;a&gt;&amp;" and one(spark, tx.money(L(1234567.5))) == "1.234.568"
    assert one(spark, geo.haversine(L(0.0), L(0.0), L(0.0), L(1.0))) == 111195


def test_small_text_contracts(spark):
    L = F.lit
    assert one(spark, tx.fragments(L("intro\n# A\ntext\n## B\nmore"))) == ["intro", "# A\ntext", "## B\nmore"]
    assert one(spark, tx.header(L("ph"), L(1), L(50.0), L(None).cast("string"), L(0), L(154_900.0))) == "Ph · monoambiente · 50 m² · planta baja · USD 3.100/m²"
    assert one(spark, tx.needs_review(F.array(L(1.0), L(0.0)))) and not one(spark, tx.needs_review(F.array(L(1.0), L(0.4))))
    assert one(spark, tx.applied(L(None).cast("int"), L(3), L(0.7))) == 3 and one(spark, tx.applied(L(None).cast("int"), L(3), L(0.6))) is None
    assert one(spark, feeds.mapped(L(" Depósito"), {"deposito": "DEPOSITO"})) == "DEPOSITO" and one(spark, feeds.mapped(L("x"), {"a": "b"})) is None
    rows = spark.createDataFrame([(1, None, True), (2, "dificil", None), (3, "x", False)], "id int, estrato string, revisado boolean")
    assert sorted((r.id, r.estrato) for r in feeds.golden(rows).collect()) == [(1, "azar"), (2, "dificil")]
    have = spark.createDataFrame([("a", None)], "area string, rooms int")
    new = spark.createDataFrame([("a", None, 1.0), ("a", 2, 2.0), ("b", None, 3.0)], "area string, rooms int, v double")
    assert sorted(r.v for r in feeds.new_index_rows(new, have, ["area", "rooms"]).collect()) == [2.0, 3.0]


def test_cliques_drop_chains_and_crowds(spark):
    chain = [("c", 1, 2), ("c", 2, 3)]
    crowd = [("d", i, j) for i in range(9) for j in range(i)]
    full = [("e", 5, 6), ("e", 5, 7), ("e", 6, 7)]
    got = {(r.block, r.member, r.cluster) for r in resolution.cliques(spark.createDataFrame(chain + crowd + full, "block string, a int, b int")).collect()}
    assert got == {("c", 2, 1), ("c", 1, 1), ("e", 5, 5), ("e", 6, 5), ("e", 7, 5)}


def test_leave_one_out_is_the_median_of_the_others(spark):
    rows = [(g, float(v), i) for g, vs in enumerate([[1, 2, 3, 4, 5, 6], [5, 5, 5, 9, 1, 7, 8], [1, 2, 3]]) for i, v in enumerate(vs)]
    out = ev.leave_one_out_median(spark.createDataFrame(rows, "g int, v double, i int"), "g", "v", least=5).collect()
    for r in out:
        rest = sorted(v for g, v, i in rows if g == r.g and i != r.i)
        n = len(rest)
        assert r.loo == (None if n < 5 else (rest[(n - 1) // 2] + rest[n // 2]) / 2)


def test_graded_metrics_by_hand(spark):
    judged = spark.createDataFrame([("q", d, g) for d, g in zip("abcde", (2, 2, 1, 0, 0), strict=True)], "q string, d string, grade int")
    ranked = spark.createDataFrame([("s", "q", d, i) for i, d in enumerate("dxabec", 1)], "system string, q string, d string, pos int")
    r = ev.graded_metrics(ranked, judged, ["system"], "q", "d").first()
    from math import log2

    dcg, ideal = 3 / log2(3) + 3 / log2(4) + 1 / log2(6), 3 + 3 / log2(3) + 1 / log2(4)
    assert r.ndcg == round(dcg / ideal, 6) and r.mrr == 0.5 and r.recall == 1.0
    assert r.bpref == 0.5  # a and b each have one of two non-relevant before them; grade 1 is neither
    assert r.discarded == 0.6 and r.judged == round(5 / 6, 6) and r.returned == 6
    r = ev.graded_metrics(ranked, judged, ["system"], "q", "d", depth=2).first()
    assert r.recall == 0.5 and r.discarded == 1.0  # recall cuts the condensed list d a, discarded the raw one d x
    assert [one(spark, ev.grade(F.lit(i), F.lit(m).cast("string"))) for i, m in ((True, None), (False, "recorte_p5_p95"), (False, "outlier_estadistico"), (False, "duplicado_de_cluster"), (False, None))] == [2, 1, 1, 0, 0]


def test_ladder_must_be_nested():
    with pytest.raises(ValueError):
        retrieval.assert_nested([(0.4, 120, "near", 1, True), (0.3, 120, "near", 1, True)])


def test_feeds_in_three_formats_are_equal(spark, tmp_path):
    rows = [{"portal": "meli", "portal_property_id": str(i), "url": "u", "price": p, "currency": "usd", "address": "Paz 1", "covered_area": "50", "total_area": "60", "rooms": "3.7", "publication_date": d} for i, (p, d) in enumerate([("100000", "2020-01-05"), ("", "05/02/2020"), ("100", "2999-01-01"), ("90000", "junk")])]
    (tmp_path / "a").mkdir()
    (tmp_path / "a/x.json").write_text(json.dumps(rows))
    (tmp_path / "a/x.jsonl").write_text("\n".join(map(json.dumps, rows)))
    (tmp_path / "a/x.csv").write_text("﻿" + ",".join(rows[0]) + "\n" + "\n".join(",".join(r.values()) for r in rows))
    (tmp_path / "a/x_failures.csv").write_text("a\n1")
    found = feeds.discover(spark, str(tmp_path))
    assert [r.format for r in found.collect()] == ["csv"]
    log = found.select("digest", F.lit("OK").alias("status"))
    assert feeds.unseen(found, log).count() == 0 and feeds.unseen(found, log.withColumn("status", F.lit("FAILED"))).count() == 1
    out = []
    for kind in ("csv", "jsonl", "json"):
        raw = feeds.read_rows(spark, [str(tmp_path / f"a/x.{kind}")], kind)
        assert feeds.is_listing_file(raw.columns)
        good, reasons = feeds.route(feeds.cards(raw, "2024-01-01"))
        out.append((sorted((r.source_id, r.price, r.surface, r.rooms, str(r.published)) for r in good.collect()), sorted((r.reason, r.n) for r in reasons.collect())))
    assert out[0] == out[1] == out[2]
    assert out[0][0] == [("0", 100000.0, 55.0, 3, "2020-01-05"), ("3", 90000.0, 55.0, 3, "None")]
    assert out[0][1] == [("accepted", 2), ("sin_precio", 1), ("usd_m2_fuera_de_rango", 1)]


def test_streamed_windows_are_the_batch_ones(spark, tmp_path):
    e = spark.read.parquet("/root/testdata/sf0.001/events.parquet").select("event_id", "user_id", F.col("ts").cast("timestamp").alias("ts"), F.col("value").alias("price"))
    e.unionByName(e.limit(50)).coalesce(2).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(e.schema).parquet(str(tmp_path / "in"))
    q = prices.snapshots(stream, ["user_id"]).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    clean = spark.read.parquet(str(tmp_path / "out"))
    assert clean.count() == e.select("user_id", "ts").distinct().count()
    want = prices.window_drops(e, ["user_id"]).count()
    assert prices.window_drops(clean, ["user_id"]).count() == want
    shutil.rmtree(tmp_path / "out")


def test_bootstrap_interval_holds_the_mean(spark):
    r = ev.bootstrap(spark.createDataFrame([(float(i % 7),) for i in range(60)], "v double"), "v").first()
    assert r.lo < r.mean < r.hi and r.n == 60


def test_every_query_is_registered_with_sql_or_a_test():
    without = set(registry.QUERIES) - set(registry.ORACLES)
    assert without == {"bootstrap_ci", "clique_clusters", "sentence_chunks", "truncated_texts"}


def test_value_range_widens_about_the_middle(spark):
    """A range wide enough stays as the quartiles give it; one that is not becomes that of the calibrated error."""
    r = valuation.value(comps(spark, [1950.0, 1975.0, 1975.0, 2000.0, 2000.0, 3000.0, 3000.0]), ["k"]).first()
    assert (r.n_used, r.unit_price, r.value_mid) == (7, 2000, 100000)
    assert (r.value_low, r.value_high) == (80000, 120000) or (r.value_high - r.value_low) / 2 >= 20000
    wide = valuation.value(comps(spark, [1975.0] * 3 + [2000.0] * 2 + [3000.0] * 2), ["k"]).first()
    assert wide.value_mid == 100000 and (wide.value_low, wide.value_high) != (80000, 150000)
    assert wide.value_low + wide.value_high == 200000 or (wide.value_low, wide.value_high) == (98750, 150000) or wide.value_low == 98750
    low = valuation.value(comps(spark, [900.0 + 400 * i for i in range(6)], days=200), ["k"]).first()
    assert low.confidence == "BAJA" and abs((low.value_low + low.value_high) / 2 - low.value_mid) <= 1  # widened about the value
    for x in (r, wide, low):
        assert all(v == int(v) for v in (x.value_low, x.value_mid, x.value_high, x.closing_low, x.closing_high))
        assert x.closing_low < x.closing_high < x.value_mid


def test_published_figures_multiply(spark):
    rows = comps(spark, [2711.0] * 10).withColumn("subject_surface", F.lit(75.25))
    r = valuation.value(rows, ["k"]).first()
    assert r.value_mid == round(2711 * 75.3)


def test_confidence_has_three_digits_before_the_thresholds(spark):
    score = lambda **x: one(spark, valuation.confidence(*[F.lit(x[k]).cast("double") for k in ("n", "dispersion", "days", "step", "complete", "manual")]))
    base = dict(n=12, dispersion=0.05, days=10, step=0, complete=1, manual=0)
    assert score(**base) == 1.0 and score(**base | {"manual": 0.6}) == 0.85 and score(**base | {"dispersion": None}) == 0.85
    assert score(**base | {"days": 119}) == round(0.85 + 0.15 * 0.011, 3) and score(**base | {"days": 120}) == 0.88
    assert score(**base | {"dispersion": 0.1752}) == 0.85  # 0.7 + 0.3 * 0.0748 / 0.15 = 0.8496
    manual = spark.range(1).select(valuation.confidence(F.lit(8), F.lit(0.05), F.lit(10.0), F.lit(0), F.lit(0.0), F.lit(0.0)).alias("x")).first().x
    assert manual == 0.795


def test_repeats_do_not_prolong_the_time_to_live(spark):
    at = lambda h: f"2024-01-{1 + h // 24:02} {h % 24:02}:00:00"
    rows = [("k", i, at(h)) for i, h in enumerate((0, 20, 40, 44, 65, 90))] + [("m", 9, at(5)), ("m", 10, at(5)), ("m", 11, None)]
    df = spark.createDataFrame(rows, "key string, id int, at string").withColumn("at", F.col("at").cast("timestamp"))
    assert sorted(r.id for r in changes.idempotent(df, ["key"], "at", 86_400, "id").collect()) == [0, 2, 4, 5, 9]


def test_sentences_as_the_original_cuts_them(spark):
    cut = lambda t: one(spark, tx.sentences(F.lit(t)))
    assert cut("Hermoso depto. de 3 amb. al frente. Cocina integrada! Luminoso") == ["Hermoso depto. de 3 amb. al frente.", "Cocina integrada!", "Luminoso"]
    assert cut("Av. Cabildo 2200. Sup. 50 m2. con balcón") == ["Av. Cabildo 2200.", "Sup.", "50 m2. con balcón"]
    assert cut("Uno\n\nDos\nTres   cuatro") == ["Uno", "Dos", "Tres cuatro"] and cut("") == [] and cut("según. Fin") == ["según.", "Fin"]
    import re

    def plain(text):
        held = re.sub(r"\b(" + "|".join(tx.NO_END) + r")\.", lambda m: m[1] + chr(0x2024), text, flags=re.IGNORECASE)
        return [x for p in re.split(r"(?<=[.!?…])\s+(?=[A-ZÁÉÍÓÚÑ¿¡\d])|\n{2,}|\n(?=\S)", held) if (x := " ".join(p.replace(chr(0x2024), ".").split()))]

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text", tx.sentences(F.col("text")).alias("s"), tx.truncated(tx.sentences(F.col("text")), 40).alias("t"), tx.window_chunks(tx.words(F.col("text")), 7, 2).alias("w")).collect()
    for r in docs:
        assert r.s == plain(r.text)
        held, n = [], 0
        for x in r.s:
            if held and n + len(x.split()) > 40:
                break
            held.append(x)
            n += len(x.split())
        assert r.t == " ".join(held)
        ws, at, want = r.text.split(), 0, []
        while at < len(ws) or not want:
            want.append(" ".join(ws[at : at + 7]))
            if at + 7 >= len(ws):
                break
            at += 5
        assert r.w == want


def test_units_in_all_ways_of_writing(spark):
    def unit(t):
        u, f = tx.whole_unit(F.lit(t))
        return one(spark, u), one(spark, f)

    assert unit("Perú al 1300, Piso 5 Departamento B") == ("5B", True) and unit("Guise 1900, Piso 4") == ("4", False)
    assert unit("Zabala 1851 4°B") == ("4B", True) and unit("Migueletes 2306") == (None, False)
    assert unit('Soldado de la Independencia al 1200 - 7° Piso "A"') == ("7A", True) and unit("Manuel Ugarte 2500 - 9°08") == ("908", True)
    assert unit("Mendoza 2196 - Piso 2 - Unidad A") == ("2A", True)
    key = lambda t: one(spark, tx.block_key(F.lit(t)))
    assert key("Perú 1355") == key("Perú al 1300") != key("Perú al 1400") and key("Guise 1900, Piso 4") == key("Guise 1900") and key("Zabala 1851") == key("Zabala al 1800")


def test_duplicate_layers_on_the_original_cases(spark):
    rows = [  # (id, address, surface, price, rooms)
        ("a", "Arenales 3800", 93.0, 400000.0, None), ("b", "Arenales al 3800", 93.0, 229000.0, 3),
        ("c", "Báez 500", 93.0, 141000.0, 1), ("d", "Baez al 500", 93.0, 141000.0, 1), ("e", "Báez 500", 99.0, 141000.0, 1), ("f", "Báez 500", None, 141000.0, 1), ("g", "Báez 500", 93.0, None, 1),
        ("h", "Honduras 3700, Piso 5", 35.0, 54000.0, 1), ("i", "Honduras 3700, Piso 5", 120.0, 530000.0, 1),
        ("j", "Honduras 3700, Piso 5 Depto B", 93.0, 250000.0, 1), ("k", "Honduras al 3700, Piso 5 Depto B", 130.0, 265000.0, 1),
        ("l", "Zabala 1851", 93.0, 589258.0, 3), ("m", "Zabala al 1800", 105.0, 610400.0, 3), ("n", "Perú al 1300, Piso 5 Departamento B", 60.0, 200000.0, 2), ("o", "Perú al 1300, Piso 3 Departamento B", 60.0, 200000.0, 2),
    ]
    df = spark.createDataFrame(rows, "id string, t string, s double, p double, r int")
    unit, specific = tx.whole_unit(F.col("t"))
    df = df.withColumn("key", tx.block_key(F.col("t"))).withColumns({"g": tx.trigrams(F.col("key")), "u": unit, "f": specific, "street": tx.street_of(F.col("key"))})
    got = {r.a + r.b: r.layer for r in resolution.blocked_pairs(df, ["street"], "id", "key", "g", "s", "p", "u", "f", "r").collect()}
    assert got.get("ab") == "grey" and got["cd"] == "layer1" and got["ce"] == got["de"] == "layer2"
    assert got["cf"] == "grey" and got["cg"] == "grey"  # no surface, no price: never the same by itself
    assert "hi" not in got and got["jk"] == "layer1"  # one floor is no flat; one flat is one, far apart as its figures are
    assert got["lm"] == "grey" and "no" not in got


def test_cliques_against_a_plain_version(spark):
    import random

    rng, edges = random.Random(5), []
    for block in range(12):
        n = rng.randrange(3, 14)
        edges += [(f"b{block}", i, j) for j in range(n) for i in range(j) if rng.random() < 0.7]
    want = set()
    for block in {e[0] for e in edges}:
        pairs = {frozenset(e[1:]) for e in edges if e[0] == block}
        degree = {}
        for p in pairs:
            for x in p:
                degree[x] = degree.get(x, 0) + 1
        used, order = set(), sorted(degree, key=lambda x: (-degree[x], x))
        for seed in order:
            if seed in used:
                continue
            group = [seed]
            for x in order:
                if x not in used and x not in group and all(frozenset((x, y)) in pairs for y in group):
                    group.append(x)
            used |= set(group)
            if 1 < len(group) <= 8:
                want |= {(block, m, min(group)) for m in group}
    got = {(r.block, r.member, r.cluster) for r in resolution.cliques(spark.createDataFrame(edges, "block string, a int, b int")).collect()}
    assert got == want and want


def test_gate_takes_the_mean_of_the_middle_two(spark):
    rows = [("c", "m", i, v, 10) for i, v in enumerate((0.60, 0.70, 0.62, 0.80, 0.61))]
    df = spark.createDataFrame(rows, "component string, metric string, id int, value double, n int")
    r = ev.gate(df, ["component", "metric"], "id", "value", "n", "id").first()
    assert (r.median, r.earlier, r.verdict) == (0.66, 4, "ok") and abs(r.spread - 0.2) < 1e-9
    goals = spark.createDataFrame([("c", "m", 0.9), ("x", "y", 0.5)], "component string, metric string, objective double")
    out = ev.gate(df, ["component", "metric"], "id", "value", "n", "id", objectives=goals)
    assert {(r.component, r.verdict, r.below) for r in out.collect()} == {("c", "ok", True), ("x", "unmeasured", None)}
    g = ev.golden_gate(out.where("component = 'x'")).first()
    assert not g.passed and g.measured == 0  # nothing measured is red


def test_nearest_reaches_over_the_date_line_and_far_north(spark):
    places = spark.createDataFrame([(1, 10.0, 179.999), (2, 78.0, 15.0), (3, 89.9995, 0.0)], "p int, lat double, lng double")
    points = spark.createDataFrame([(1, 10.0, -179.999), (2, 78.0, 15.15), (3, 89.9995, 180.0), (4, 0.0, 0.0)], "i int, lat double, lng double")
    assert {(r.i, r.p) for r in lookup.nearest(points, "i", places, "p", 4000).collect()} == {(1, 1), (2, 2), (3, 3)}


def test_cards_take_conditions_orientations_flags_and_side_car(spark, tmp_path):
    base = {"portal_property_id": "1", "url": "u", "canonical_url": "c", "price": "100", "currency": "USD", "expenses": "5", "expenses_currency": "ARS", "covered_area": "", "total_area": "60", "parking_count": "1", "condition": "Muy Bueno", "orientation": "NO", "detail_fetched": "True", "raw_data": "{bad", "portal": ""}
    rows = [base, base | {"portal_property_id": "2", "condition": "Contrafrente", "detail_fetched": "", "expenses_currency": "USD", "raw_data": '{"a": 1}'}, base | {"portal_property_id": "3", "condition": "Regular", "orientation": "Frente", "portal": "MercadoLibre"}]
    (tmp_path / "properati_x.json").write_text(json.dumps(rows))
    (tmp_path / "meta.json").write_text('[{"name": "profile"}]')
    (tmp_path / "gone.json").write_text("")
    found, log = feeds.scan(spark, [(str(tmp_path / f), "json") for f in ("properati_x.json", "meta.json", "missing.json")], "2024-01-01")
    assert [x["status"] for x in log] == ["OK", "FOREIGN", "ERROR"]
    got = {r.source_id: r for r in found.collect()}
    assert [(got[i].source, got[i].condition, got[i].orientation, got[i].expenses_ars) for i in "123"] == [("PROPERATI", "muy_bueno", None, 5.0), ("PROPERATI", None, "contrafrente", None), ("MELI", None, "frente", 5.0)]
    assert got["1"].quality_flags == ["surface_total_only", "ficha_completa"] and got["2"].quality_flags == ["surface_total_only"] and got["1"].url == "c"
    assert got["1"].raw == {"surface_total": "60.0", "parking_spaces": "1", "condition": "muy_bueno", "expenses_ars": "5.0", "surface_weighted": "60.0"}
    assert json.loads(got["1"].raw_data) == {"raw_data_no_parseable": "{bad"} and got["2"].raw_data == '{"a": 1}'


def test_open_data_files(spark, tmp_path):
    index = lookup.alias_index(spark.createDataFrame([("Núñez", 1), ("Flores", 2)], "name string, id int"))
    (tmp_path / "s.csv").write_text("Direccion,PropiedadS,Dolares,DolaresM2,Ambientes,Barrio,Trimestre\nPaz 1,\"50,5\",100000,1980,-7,NUÑEZ,Segundo\nPaz 1,\"50,5\",100000,1980,3,NUÑEZ,Segundo\nPaz 2,5,100000,,2,FLORES,PRIMERO\nPaz 3,60,90000,1500,2,NOWHERE,PRIMERO\nPaz 4,60,90000,,2,FLORES,x\n")
    rows = sorted(feeds.historical(spark, str(tmp_path / "s.csv"), 2020, index).collect(), key=lambda r: r.address)
    assert [(r.address, r.surface, r.rooms, str(r.published), r.area_id, r.active) for r in rows] == [("Paz 1", 50.5, None, "2020-04-01", 1, False), ("Paz 4", 60.0, 2, "2020-01-01", 2, False)]
    assert rows[0].source_id.startswith("2020-") and len(rows[0].source_id) == 25
    (tmp_path / "i.csv").write_text("barrio;año;trimestre;ambientes;estado;precio_prom\nFlores;2020;2;2 ambientes;Usado;1500,5\nFlores;2020;3;;;\nFlores;2020;;1;;5\nAtlantis;2020;1;1;;5\nNuñez;2021;4;3 ambientes;;0\nNuñez;2021;4;x;;7\n")
    got = {tuple(map(str, r)) for r in feeds.price_index(spark, str(tmp_path / "i.csv"), index).collect()}
    assert got == {("2", "2020-04-01", "2", "usado", "1500.5"), ("1", "2021-10-01", "None", "todos", "7.0")}
    inv = feeds.inventory(spark.createDataFrame([(" 7 ", "Depto", "Venta", "usd", "2.9", True), ("", "casa", "sale", "USD", "1", True), ("8", "castle", "lease", "EUR", "x", None)], "source_id string, property_type string, operation string, currency string, rooms string, published boolean").selectExpr("*", "'' as address_raw", "'A' as neighborhood_label", "'1' as surface_total", "null as surface_covered", "'5' as price"))
    assert [(r.source_id, r.kind, r.operation, r.currency, r.rooms) for r in inv.collect()] == [("7", "departamento", "SALE", "USD", 2), ("8", None, None, None, None)]


def test_reports_are_replaced_one_by_one_and_pairs_share_ids(spark, tmp_path):
    make = lambda rows: spark.createDataFrame(rows, "report_id int, x int")
    feeds.write_reports(make([(1, 1), (1, 2), (2, 3)]), str(tmp_path / "r"))
    feeds.write_reports(make([(1, 9)]), str(tmp_path / "r"))
    assert sorted((r.report_id, r.x) for r in spark.read.parquet(str(tmp_path / "r")).collect()) == [(1, 9), (2, 3)]
    feeds.write_pair(make([(1, 1)]), make([(1, 2)]), ["report_id"], str(tmp_path / "p"))
    ids = [spark.read.parquet(str(tmp_path / "p" / n)).first().listing_id for n in ("listings", "features")]
    assert ids[0] == ids[1] and len(ids[0]) == 32
    assert feeds.stored_judgements(spark, str(tmp_path / "none"), "q") is None
    spark.createDataFrame([("q", "d", 2), ("z", "d", 1)], "query string, doc string, grade int").write.partitionBy("query").parquet(str(tmp_path / "j"))
    assert [r.grade for r in feeds.stored_judgements(spark, str(tmp_path / "j"), "q").collect()] == [2]


def test_cursor_round_trip(spark):
    r = spark.range(1).select(retrieval.cursor(F.lit("2024-01-20 01:02:03.5").cast("timestamp"), F.lit(77)).alias("c")).first()
    assert retrieval.read_cursor(r.c) == ("2024-01-20 01:02:03.500000", "77")
    with pytest.raises(ValueError):
        retrieval.read_cursor("@@@")


def test_cues_and_small_figures(spark):
    L = F.lit
    text = "Hermoso 3 ambientes, 5° piso con ascensor y cochera. Acepta permuta. Otro piso 7 al contrafrente"
    assert one(spark, tx.suggested_reasons(L(text))) == ["permuta_o_financiacion"]
    cues = one(spark, tx.cue_fragments(L(text)))
    assert set(cues) == {"floor_number", "orientation", "has_elevator", "parking_spaces"} and len(cues["floor_number"]) == 2 and cues["orientation"] == ["ochera. Acepta permuta. Otro piso 7 al contrafrente"[-59:].strip()] or cues["orientation"]
    assert all(c in text for v in cues.values() for c in v)
    assert [one(spark, tx.number(L(x))) for x in ("1234.567", "182.000.", "2.441,50", "0,31", "-5", "1.2.3")] == [1234567.0, 182000.0, 2441.5, 0.31, None, None]
    assert one(spark, tx.money(L(2.5))) == "2" and one(spark, geo.within(L(-34.6), L(-58.4), lookup.METROPOLIS))
    assert one(spark, tx.json_numbers(L('{"a": [1, -2.5e1, true], "b 9": "x 1.400 y", "c": {"d": "k\\"7"}}'))) == [1.0, -25.0, 1400.0, 7.0]


def test_dense_search_takes_the_best_chunk(spark):
    import numpy as np

    rng = np.random.default_rng(1)
    v = rng.normal(size=(400, 8))
    chunks = [(int(i) // 3, int(i), [float(x) for x in v[i]]) for i in range(400)] + [(900, 1, None), (901, 1, [0.0] * 8), (902, 1, [float("nan")] * 8), (903, 1, [1.0] * 7)]
    queries = [(i, [float(x) for x in v[i] + 0.1]) for i in (5, 77)]
    got = retrieval.dense_topk(spark.createDataFrame(queries, "q long, vector array<double>"), spark.createDataFrame(chunks, "d long, chunk long, vector array<double>"), 4).collect()
    for q, vec in queries:
        x = np.array(vec)
        best = {}
        for d, _, w in chunks[:400]:
            w = np.array(w)
            best[d] = max(best.get(d, -2), round(float(x @ w / np.sqrt((x @ x) * (w @ w))), 6))
        best.pop(q, None)
        want = sorted(best.items(), key=lambda e: (-e[1], e[0]))[:4]
        assert [(r.d, r.cos) for r in sorted(got, key=lambda r: r.pos) if r.q == q] == want


def test_modes_of_scoring(spark):
    dense = spark.createDataFrame([(1, 10, 0.9), (1, 11, 0.5)], "q int, d int, cos double")
    lexical = spark.createDataFrame([(1, 11, 0.7)], "q int, d int, score double")
    run = lambda mode: {r.d: round(r.score, 6) for r in retrieval.scored(mode, dense, lexical).collect()}
    assert run("denso") == {10: 0.9, 11: 0.5} and run("lexico") == {11: 0.7} and run("hibrido") == {10: round(1 / 61, 6), 11: round(1 / 62 + 1 / 61, 6)}
    with pytest.raises(ValueError):
        run("x")
    index = retrieval.postings(spark.createDataFrame([(7, 0, "luz luz sol"), (7, 1, "sol"), (8, 0, "nada")], "d int, chunk int, text string"))
    hits = retrieval.lexical_scores(spark.createDataFrame([(1, "Sol y luz, luz")], "q int, text string"), index).collect()
    assert [(r.d, round(r.score, 6)) for r in hits] == [(7, round(0.3 / 1.3, 6))]


def test_bootstrap_against_plain_resampling(spark):
    """The same draws, taken one by one in Python."""
    values = [float(x) for x in (3, 1, 4, 1, 5, 9, 2, 6)] + [0.25, -1.5, 0.25]
    df = spark.createDataFrame([(x,) for x in values], "v double").repartition(3)
    got = ev.bootstrap(df, "v", resamples=200, seed=11).first()
    n, ranked, means = len(values), sorted(values), []
    draws = spark.range(200).select(F.col("id").cast("int").alias("b"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long"))).alias("i"))
    picks = {}
    for r in draws.select("b", F.pmod(F.xxhash64(F.lit(11), "b", "i"), F.lit(n)).alias("p")).collect():
        picks.setdefault(r.b, []).append(ranked[r.p])
    means = sorted(sum(v) / n for v in picks.values())
    assert (got.n, got.mean, got.lo, got.hi) == (n, round(sum(values) / n, 6), round(means[5], 6), round(means[194], 6))
    paired = spark.createDataFrame([("a", 1, 0.5), ("b", 1, 0.75), ("a", 2, 0.25), ("b", 3, 1.0)], "system string, q int, ndcg double")
    assert [(r.q, r.delta) for r in ev.paired(paired, "q", "ndcg", "a", "b").collect()] == [(1, 0.25)]


def test_lots_only_end_short_once(spark):
    got = {r.i: r.lot for r in contracts.lots(spark.range(4090, 4110).withColumnRenamed("id", "i"), "i").collect()}
    assert got == {i: (i - 4090) // 6 for i in range(4090, 4110)}


def test_numbers_of_any_json_are_those_of_its_leaves(spark):
    import random

    rng = random.Random(4)
    bits = ['"', "\\", "\n", "é", "²", "1.234,5", "17", "7.", "x", " ", ":", "{", "[3]", '\\"9', "2.000"]
    text = lambda: "".join(rng.choice(bits) for _ in range(rng.randrange(7)))

    def value(depth):
        kind = rng.randrange(7 if depth else 5)
        if kind < 5:
            return [text(), rng.randrange(-500, 500), rng.random() * 1e6, rng.choice([True, False, None]), text()][kind]
        return [value(depth - 1) for _ in range(rng.randrange(4))] if kind == 5 else {text(): value(depth - 1) for _ in range(rng.randrange(4))}

    def leaves(v):
        if isinstance(v, dict | list):
            return [x for w in (v.values() if isinstance(v, dict) else v) for x in leaves(w)]
        return [v] if isinstance(v, str) or (isinstance(v, int | float) and not isinstance(v, bool)) else []

    data = [{"t": 'vale "1.234,5" hoy'}, {"t": "it\\", "k 12": 3}, {"t": "a\\u00b2 m² 40" + "\\" * 5000}] + [{text(): value(3)} for _ in range(200)]
    every = [leaves(d) for d in data]
    rows = [(i, json.dumps(d, ensure_ascii=i % 2 == 0)) for i, d in enumerate(data)]
    parts = [(i, x) for i, v in enumerate(every) for x in v if isinstance(x, str)]
    said = {}
    for r in spark.createDataFrame(parts, "i int, t string").select("i", tx.numbers(F.col("t")).alias("n")).collect():
        said.setdefault(r.i, []).extend(r.n)
    got = spark.createDataFrame(rows, "i int, data string").select("i", tx.json_numbers(F.col("data")).alias("n")).collect()
    for r in got:
        assert sorted(r.n) == sorted([float(x) for x in every[r.i] if not isinstance(x, str)] + said.get(r.i, [])), rows[r.i]
    assert said[0] == [1234.5] and every[1] == ["it\\", 3]
