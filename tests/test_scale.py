"""Cases of larger tables on literal rows: single classes, shared roll-ups, all trusted documents."""

import math
import random
from datetime import datetime
from pathlib import Path

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from logtide import session
from logtide.llm import linededup, neardup, quality
from logtide.operators import learned, users, volume


@pytest.mark.parametrize("bot", [False, True])
def test_importances_of_a_single_class_are_zero(spark, bot):
    """A large log can put every location in one class; a forest of one class gives scores of length 1."""
    rows = spark.createDataFrame([(f"l{i}", float(i), float(i % 3)) for i in range(12)],
                                 "geo_location string, unique_users double, hourly_entropy double")
    found = learned.surrogate_importances(rows, ["unique_users", "hourly_entropy"], F.lit(bot), trees=3, repeats=1,
                                          depth=3).collect()
    assert [tuple(r) for r in found] == [("unique_users", 0.0, 0.0), ("hourly_entropy", 0.0, 0.0)]


def test_every_trusted_document_fits_the_target(spark):
    """More trusted documents than the 20,000 that once fitted it; repeated rows count, null and repeated ids do not."""
    n = 20_500
    docs = spark.range(n).select(F.col("id").alias("doc_id"), F.concat_ws(" ", F.lit("word"), F.col("id").cast("string"))
                                 .alias("text"))
    docs = docs.union(docs.where("doc_id = 0")).union(docs.where("doc_id = 1").withColumn("doc_id", F.lit(None).cast("long")))
    ids = spark.range(n).select(F.col("id").alias("doc_id"))
    trusted = ids.union(ids.where("doc_id < 5")).union(ids.limit(1).select(F.lit(None).cast("long")))
    halves = quality.trusted_halves(trusted)
    target = quality.trusted_grams(docs, halves)
    assert halves.count() == n and target.count() == n + 1
    # All but the document without an id are trusted, so both multinomials are almost equal.
    ratios = quality.log_ratios(docs, halves, target).first()
    assert len(ratios["llr"]) == quality.BUCKETS and max(map(abs, ratios["llr"])) < 0.3
    assert quality.log_ratios(docs, quality.trusted_halves(trusted.where("false")), target.where("false")) \
        .first()["llr"] == [0.0] * quality.BUCKETS


def test_log_ratios_count_all_documents(spark):
    texts = ["a b c", "a a d", "d e f", "", None, "a b c"]
    docs = spark.createDataFrame(list(enumerate(texts)) + [(1, texts[1]), (None, "x y")], "doc_id long, text string")
    halves = quality.trusted_halves(spark.createDataFrame([(1,), (2,), (4,)], "doc_id long"))
    found = quality.log_ratios(docs, halves, quality.trusted_grams(docs, halves)).first()
    grams = docs.select("doc_id", quality.grams(F.col("text")).alias("g")).collect()
    raw, t = [0] * quality.BUCKETS, [0] * quality.BUCKETS
    for r in grams:
        for b in r["g"]:
            raw[b] += 1
            t[b] += r["doc_id"] in (1, 2, 4)
    expected = [math.log((x + 1) / (y * sum(t) / sum(raw) + 1)) for x, y in zip(t, raw)]
    assert found["llr"] == pytest.approx(expected)


HOUR = datetime(2024, 1, 1, 10)
ROWS = [{"ts": HOUR, "usr": "u1"}, {"ts": HOUR, "usr": "u1", "filename": None, "accession": "P2"},
        {"ts": HOUR.replace(hour=11), "usr": None}, {"ts": HOUR.replace(year=2023), "usr": "u2", "accession": None},
        {"ts": None, "usr": "u3", "filename": "f2.raw"}, {"ts": HOUR.replace(year=1980), "usr": "u4"},
        {"ts": HOUR, "usr": "u1"}, {"ts": HOUR, "usr": "u5", "geo_location": None},
        {"ts": HOUR, "usr": None, "accession": None, "geo_location": "3.0,4.0", "method": None}]


def expands(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Expand")


def test_base_statistics_count_each_column_by_itself(make_log):
    """No event is repeated for several distinct counts; nulls and years before the first count as before."""
    found = volume.base_stats(make_log(ROWS))
    assert expands(found) == 0
    rows = {r["geo_location"]: r.asDict() for r in found.collect()}
    names = ("unique_users", "total_downloads", "unique_projects", "active_hours", "years_active", "first_year", "last_year")
    assert {k: tuple(r[n] for n in names) for k, r in rows.items()} == {
        "1.0,2.0": (2, 5, 2, 3, 2, 2023, 2024), "3.0,4.0": (0, 1, 0, 1, 1, 2024, 2024)}
    assert rows["3.0,4.0"]["downloads_per_user"] is None


def test_authenticity_counts_files_and_days_by_themselves(make_log):
    """Users u1 (twice f1, one day), u2, u3 (no time: no day) and u4."""
    found = users.user_authenticity(make_log(ROWS))
    assert expands(found) == 0
    row = found.collect()[0]
    assert (row["avg_active_days_per_user"], row["avg_files_per_user"]) == (3 / 4, 1.0)
    assert row["user_homogeneity_score"] == pytest.approx(1.25 / 0.5)


def test_hours_come_from_the_users_of_each_hour(make_log):
    views = make_log(ROWS).stored()
    plain = sorted(tuple(r) for r in make_log(ROWS).hour.collect())
    views.hour_users
    assert sorted(tuple(r) for r in views.hour.collect()) == plain


def test_protocols_without_a_method(make_log):
    row = volume.protocol_mix(make_log(ROWS)).where("geo_location = '3.0,4.0'").first()
    assert (row["http_ratio"], row["ftp_ratio"], row["protocol_diversity"]) == (0.0, 0.0, 0)


def plan_of(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_trusted_ids_are_looked_up_in_blocks(spark):
    """Ids that lie together share a row, so the texts need no shuffle; far, negative, repeated and null ids keep theirs."""
    ids = [*range(3000), -1, -1024, -1025, 2 ** 62, None, 5, 5]
    halves = quality.trusted_halves(spark.createDataFrame([(i,) for i in ids], "doc_id long"))
    blocks = quality.id_blocks(halves)
    assert blocks.count() == 6
    asked = [*range(0, 4000, 7), 2999, 3000, -1, -2, -1024, -1025, -1026, 2 ** 62, 2 ** 62 + 1, None, 7]
    found = quality.with_half(spark.createDataFrame([(i, "t") for i in asked], "doc_id long, text string"), blocks)
    expected = {r["_id"]: r["_half"] for r in halves.collect()}
    assert sorted(map(str, found.select("doc_id", "_half").collect())) == sorted(
        f"Row(doc_id={i}, _half={expected.get(i)})" for i in asked)


def test_texts_are_read_for_their_grams_once(spark):
    texts = ["", None, " \t", "Ab ab AB", "ÄÖ äö Éa ﬁ İ ı K", "x\x0by  z\n\nZ9 #a##", "^ ^^ A1-b__C"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    both = quality._counted(docs).select(quality.grams(F.col("text")).alias("a"),
                                         quality.grams(F.col("text"), tokens=F.col("_words")).alias("b"))
    assert all(r["a"] == r["b"] for r in both.collect())
    judged = quality.judge(docs, docs.where("doc_id > 2").select("doc_id"))
    assert "split" not in plan_of(judged.where("kept")) and judged.columns[:3] == ["doc_id", "text", "n_words"]
    assert "text" not in quality.judge(docs, docs.select("doc_id"), text=False).columns


def test_leftovers_meet_by_narrow_rows(spark):
    """The pairs of a brute-force count, from rows that do not carry a member's spans along with each of them."""
    rng = random.Random(7)
    rows = []
    for hub in (1, 2):
        for node in range(40):
            inside, rest = rng.randint(10, 60), sorted(rng.sample(range(25), rng.randint(2, 22)))
            rows.append((hub, hub * 100 + node, inside + len(rest), inside, rng.randint(0, 30), rest, 1000))
    frame = spark.createDataFrame(rows, "hub long, node long, n long, inside long, root long, rest array<long>, least long")
    expected = set()
    for x in rows:
        for y in rows:
            shared = len(set(x[5]) & set(y[5]))
            if x[0] == y[0] and x[1] < y[1] and x[4] != y[4] and shared and 4 * min(x[2], y[2]) >= 3 * max(x[2], y[2]) \
                    and 7 * (min(x[3], y[3]) + shared) >= 3 * (x[2] + y[2]):
                expected.add((x[1], y[1]))
    found = neardup.leftovers(frame)
    assert {tuple(r) for r in found.collect()} == expected and len(expected) > 50
    joins = [line for line in plan_of(found).splitlines() if "Join Inner" in line]
    assert not any("array_intersect" in line and "span#" in line for line in joins)


def test_open_links_match_all_pairs(spark):
    """Members about as far from their hub as a link allows: all linked pairs, and few rows that are not."""
    rng = random.Random(11)
    sets, rows = {}, []
    for hub, size in ((1, 40), (2, 60)):
        base = [hub * 10_000 + i for i in range(size)]
        families = [base, *[[x for x in base if rng.random() > 0.15] + [hub * 10_000 + 500 + 40 * f + i for i in range(6)]
                            for f in range(8)]]
        for node in range(60):
            family = rng.choice(families)
            own = {x for x in family if rng.random() > 0.12} | {hub * 10_000 + 5000 + rng.randrange(400) for _ in range(rng.randint(0, 9))}
            key = hub * 100 + node
            sets[key] = own
            rows.append((hub, key, len(own), key % 37, sorted(own ^ set(base))))
    most = {hub: max(r[2] for r in rows if r[0] == hub) for hub in (1, 2)}
    frame = spark.createDataFrame([(*r[:4], most[r[0]], r[4]) for r in rows],
                                  "hub long, node long, n long, root long, most long, apart array<long>")
    expected = {(x[1], y[1]) for x in rows for y in rows if x[0] == y[0] and x[1] < y[1] and x[3] != y[3]
                and set(x[4]) & set(y[4])
                and 100 * len(sets[x[1]] & sets[y[1]]) >= 75 * len(sets[x[1]] | sets[y[1]])}
    found = neardup.open_links(frame)
    assert {tuple(r) for r in found.collect()} == expected and 20 < len(expected) < 1500


def test_line_dedup_joins_each_text_once(spark):
    docs = spark.createDataFrame([(1, "one line here\nother", "en", "s", 19), (2, "one line here", "en", "s", 13),
                                  (3, None, "en", "s", None)], "doc_id long, text string, lang string, source string, n_chars long")
    found = corpus_pipeline.line_dedup(spark, docs, "")
    assert plan_of(found).count("array_join(") == 1
    assert [tuple(r) for r in found.select("doc_id", "text", "n_chars").orderBy("doc_id").collect()] \
        == [(1, "one line here\nother", 19)]


def test_line_dedup_shuffles_no_text_for_its_mates(spark):
    """Texts meet the kept lines in one join; lines with a mate reach their shuffle through a bitmap."""
    docs = spark.createDataFrame([(1, "one line here\n \nother"), (2, None)], "doc_id long, text string")
    firsts = linededup.first_places(linededup.places(docs), 8)
    spots = spark.createDataFrame([(1, 0)], "doc_id long, at int")
    cells = linededup.bitmap(spots, F.xxhash64("doc_id", "at")).first()["map"]
    assert len(cells) == 1 << linededup.MAP_BITS and sum(bin(x & (2 ** 64 - 1)).count("1") for x in cells) == 1
    wanted = spark.range(0, 400, 2).select(F.xxhash64("id").alias("h"))
    passed = linededup.likely(spark.range(400).select("id", F.xxhash64("id").alias("h")), F.col("h"), wanted)
    assert {r["id"] for r in passed.collect()} == set(range(0, 400, 2))
    assert linededup.near_copies(docs, firsts).count() == 0
    done = linededup.dedup_lines(docs)
    assert "posexplode" not in plan_of(done)
    assert [tuple(r) for r in done.select("text", "n_lines", "n_removed").orderBy("doc_id").collect()] \
        == [("one line here\n \nother", 3, 0), (None, 0, 0)]


def test_variants_share_keys_without_hashing_words_again(spark):
    """Equal keys for equal word sequences only, lines of 1, 2 and more words and repeated words included."""
    lines = ["a", "a b", "b a", "a a", "a a a", "a b c d e f g h", "a b c d f g h", "a b c d X f g h", "a b c d e f g h i",
             "b b b b b b b b b", "b b b b b b b b"]
    frame = spark.createDataFrame([(i, x.split()) for i, x in enumerate(lines)], "place long, tokens array<string>")
    rows = linededup.variants(frame).collect()
    left, keys = {}, {}
    for r in rows:
        w = lines[r["place"]].split()
        what = tuple(w if r["pos"] < 0 else w[:r["pos"]] + w[r["pos"] + 1:])
        assert r["size"] == len(what)
        left.setdefault(what, set()).add(r["key"])
        keys.setdefault((r["key"], r["size"]), set()).add(what)
    assert all(len(x) == 1 for x in left.values()) and all(len(x) == 1 for x in keys.values())
    assert len(rows) == sum(len(x.split()) + 1 for x in lines)
    assert "xxhash64(concat(" not in plan_of(linededup.variants(frame))


def test_halves_of_spaced_lines(spark):
    texts = ["a b c d e f g h", " a b  c d e f\tg h ", "a b c d e f g h i", "z b c d e f g h i", "\x0ba\r", "   ", ""]
    rows = spark.createDataFrame(list(enumerate(texts)), "i long, line string") \
        .withColumn("s", linededup.spaced(F.col("line"))).withColumn("n", linededup.word_count(F.col("s"))) \
        .withColumn("halves", linededup.halves(F.col("s"), F.col("n"))).orderBy("i").collect()
    assert [r["s"] for r in rows] == [" ".join(t.split()) for t in texts]
    assert [r["n"] for r in rows[:5]] == [8, 8, 9, 9, 1]
    assert rows[0]["halves"] == rows[1]["halves"]
    assert set(rows[0]["halves"]) & set(rows[2]["halves"]) and set(rows[2]["halves"]) & set(rows[3]["halves"])
    assert not set(rows[0]["halves"][:2]) & set(rows[3]["halves"][:2])


def test_projects_are_not_ranked_one_by_one(spark):
    """The three largest shares from counts of equal projects, ties across the third place included."""
    class Views:
        project = spark.createDataFrame(
            [("a", f"p{i}", n) for i, n in enumerate([5, 5, 4, 4, 4, 1])] + [("b", "p", 2), ("b", "q", 1)],
            "geo_location string, accession string, n long")
    found = volume.project_concentration(Views)
    assert not any("Window" in line and "accession" in line for line in plan_of(found).splitlines())
    assert {r[0]: tuple(r)[1:] for r in found.collect()} == {
        "a": (5 / 23, 14 / 23, pytest.approx(99 / 529)), "b": (2 / 3, 1.0, pytest.approx(5 / 9))}


def test_pipeline_leaves_only_the_tables_of_its_stages(spark):
    """What a stage wrote on its way no longer fills the disk of those after it; results of stages stay."""
    folder = Path(session.session_folder(spark))
    before = set(folder.iterdir()) if folder.exists() else set()
    rows = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    left = {p.name.rsplit("-", 1)[0] for p in set(folder.iterdir()) - before}
    assert left == {f"pipeline-{name}" for name, _ in corpus_pipeline.STAGES} and rows.count() > 0


def test_noted_tables_are_those_written_inside(spark):
    one = spark.range(3)
    with session.noted_tables() as outer:
        first = session.materialise(one, "first")
        with session.noted_tables() as inner:
            session.materialise(one, "second")
    session.materialise(one, "third")
    assert [[p.rsplit("/", 1)[1].rsplit("-", 1)[0] for p in found] for found in (outer, inner)] == [["first", "second"], ["second"]]
    session.release_tables(spark, inner)
    assert first.count() == 3 and not Path(inner[0]).exists() and Path(outer[0]).exists()


def test_a_stored_log_holds_times_as_microseconds(spark, make_log):
    rows = [{"ts": HOUR.replace(microsecond=123456)}, {"ts": None}, {"ts": datetime(1969, 12, 31, 23, 59, 59, 999999)},
            {"ts": datetime(1582, 10, 4)}]
    views = make_log(rows, min_year=1)
    stored = views.stored()
    assert dict(spark.read.parquet(*stored.log.inputFiles()).dtypes)["ts"] == "bigint"
    assert stored.log.dtypes == views.log.dtypes and sorted(map(str, stored.log.collect())) == sorted(map(str, views.log.collect()))
