"""Training-data operators against brute force, on small tables with nulls, empty texts, ties and repeats."""

from __future__ import annotations

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from logtide.llm import bpe, components, langid, linededup, neardup, neighbours, packing, quality, quotes, wrappers

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, lang string, source string, n_chars long, kept string, score string, node long"


def words_of(rng, n, vocabulary=400):
    return [f"w{rng.randrange(vocabulary)}" for _ in range(n)]


def docs_of(spark, texts, first=0):
    rows = [(first + i, t, "en", f"s{i % 3}", 7, "x", "y", 1) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS).repartition(3)


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(11)
    base = [" ".join(words_of(rng, rng.randrange(30, 90))) for _ in range(25)]
    texts = [None, "", " \n\t ", "one", "One two three", "one two three", "x" * 30000]
    for t in base:
        texts.append(t)
        for k in (1, 2, 4, 8):
            w = t.split()
            for _ in range(k):
                w[rng.randrange(len(w))] = "changed" + str(rng.randrange(3))
            texts.append(" ".join(w))
    return texts + base[:5] + [base[0].upper()]


def reference_components(texts):
    sets = []
    for t in texts:
        w = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
        sets.append({tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    parent = list(range(len(texts)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x
    for i, a in enumerate(sets):
        for j in range(i):
            if a and 100 * len(a & sets[j]) >= 75 * len(a | sets[j]):
                x, y = sorted((find(i), find(j)))
                parent[y] = x
    return [(len(s), find(i)) for i, s in enumerate(sets)]


def test_near_duplicates_match_all_pairs(spark, corpus):
    rows = neardup.near_duplicates(docs_of(spark, corpus)).collect()
    expected = reference_components(corpus)
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in rows} == dict(enumerate(expected))
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in rows)


def test_near_duplicates_edges(spark):
    docs = spark.createDataFrame([(None, "a b c d e f"), (1, "a b c d e f"), (1, "a b c d e f"), (2, None)],
                                 "doc_id long, text string")
    rows = neardup.near_duplicates(docs).collect()
    assert Counter((r["doc_id"], r["component_id"], r["kept"]) for r in rows) == Counter(
        [(None, 1, False), (1, 1, True), (1, 1, True), (2, 2, True)])
    assert neardup.near_duplicates(docs.where("false")).count() == 0


def test_leftover_pairs_are_found(spark):
    """Two members of a hub's list that the hub itself does not link."""
    hub = list(range(100))
    pair = [hub[:62] + list(range(1000, 1038)), hub[:62] + list(range(1000, 1036)) + [7, 2000]]
    rows = [(1, 10 + i, len(set(s)), len(set(s) & set(hub)), 10 + i, [x for x in set(s) if x not in hub], 50)
            for i, s in enumerate(pair)]
    frame = spark.createDataFrame(rows, "hub long, node long, n long, inside long, root long, rest array<long>, least long")
    assert [tuple(r) for r in neardup.leftovers(frame).collect()] == [(10, 11)]


def test_components_of_a_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(200)] + [(500, 501)], "a long, b long")
    found = {r["node"]: r["root"] for r in components.components(edges).collect()}
    assert found == {i: 0 for i in range(201)} | {500: 500, 501: 500}


def brute_lines(texts, least=8):
    first, kept = {}, []
    for i, t in enumerate(texts):
        for at, line in enumerate(t.split("\n") if t is not None else []):
            if WORD.search(line):
                first.setdefault(line, (i, at))
    places = [(p, WORD.findall(line)) for line, p in first.items() if len(WORD.findall(line)) >= least]

    def near(a, b):
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b, strict=True)) <= 1
        a, b = sorted((a, b), key=len)
        return len(b) - len(a) == 1 and any(b[:i] + b[i + 1:] == a for i in range(len(b)))
    gone = {p for p, w in places for q, v in places if q < p and near(w, v)}
    for i, t in enumerate(texts):
        kept.append(None if t is None else "\n".join(
            line for at, line in enumerate(t.split("\n"))
            if not WORD.search(line) or (first[line] == (i, at) and (i, at) not in gone)))
    return kept


def test_line_dedup_matches_all_pairs(spark):
    rng = random.Random(4)
    lines = [" ".join(words_of(rng, rng.randrange(6, 14))) for _ in range(30)]
    changed = []
    for line in lines:
        w = line.split()
        i = rng.randrange(len(w))
        changed += [" ".join(w[:i] + ["new"] + w[i + 1:]), " ".join(w[:i] + w[i + 1:]), " ".join([*w[:i], "more", *w[i:]]),
                    "  ".join(w)]
    pool = lines + changed + ["", " ", "short line"]
    texts = ["\n".join(rng.choice(pool) for _ in range(rng.randrange(1, 6))) for _ in range(60)] + [None, "", "\n"]
    rows = linededup.dedup_lines(docs_of(spark, texts)).collect()
    expected = brute_lines(texts)
    assert {r["doc_id"]: r["text"] for r in rows} == dict(enumerate(expected))
    assert all(r["n_lines"] >= r["n_removed"] >= 0 and r["kept"] == "x" for r in rows)
    assert linededup.dedup_lines(docs_of(spark, texts).where("false")).count() == 0


def base_reference(text):
    w = WORD.findall(text or "")
    grams = Counter(tuple(w[i:i + 5]) for i in range(len(w) - 4))
    covered = {i + k for i in range(len(w) - 4) if grams[tuple(w[i:i + 5])] > 1 for k in range(5)}
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    return (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(covered),
            len(w) < 10 or 100 * len(covered) > 20 * len(w))


def test_quality_base_counts(spark, corpus):
    texts = [*corpus, "a b c d e " * 5, "x # y | z\nx # y | z\n\n \nq", "🙂é wörd " * 12, "one two three four five six " * 2]
    rows = quality.base_columns(docs_of(spark, texts)).collect()
    for r in rows:
        found = (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"])
        assert found == base_reference(texts[r["doc_id"]]), texts[r["doc_id"]]


def test_quality_separates_shapes(spark):
    rng = random.Random(2)
    good = [" ".join(words_of(rng, 30, 5000)).capitalize() + ". Then more of it." for _ in range(60)]
    bad = [" ".join(x + "***" for x in words_of(rng, 30, 5000)) for _ in range(20)]
    docs = docs_of(spark, good + bad + [None])
    trusted = spark.createDataFrame([(i,) for i in range(0, 40)] + [(None,), (3,)], "doc_id long")
    rows = {r["doc_id"]: r["kept"] for r in quality.judge(docs, trusted).collect()}
    assert all(rows[i] for i in range(60)) and not any(rows[i] for i in range(60, 81))
    none = quality.judge(docs, trusted.where("false")).collect()
    assert {r["llr"] for r in none} == {0.0}
    assert quality.judge(docs.where("false"), trusted).count() == 0


def test_quality_reads_the_words_not_only_their_shapes(spark):
    rng = random.Random(4)
    good, spam = words_of(rng, 80, 5000), [f"{a}{b}q" for a in "abcdefgh" for b in "klmnoprs"]
    texts = [" ".join(rng.choices(good, k=40)) + "." for _ in range(60)]
    texts += [" ".join(rng.choices(spam, k=40)) + "." for _ in range(20)]
    trusted = spark.createDataFrame([(i,) for i in range(40)], "doc_id long")
    rows = {r["doc_id"]: r["kept"] for r in quality.judge(docs_of(spark, texts), trusted).collect()}
    assert all(rows[i] for i in range(60)) and not any(rows[i] for i in range(60, 80))


def test_language_held_out_accuracy(spark):
    rng = random.Random(9)
    letters = {"aa": "abcdefgh", "bb": "nopqrstu", "cc": "áéíóúüñç"}
    rows = []
    for i in range(240):
        lang = list(letters)[i % 3]
        text = " ".join("".join(rng.choice(letters[lang]) for _ in range(rng.randrange(2, 7))) for _ in range(40))
        rows.append((i, text, lang))
    docs = spark.createDataFrame(rows + [(900, None, "aa"), (901, "12 !?", "bb"), (902, "", None)],
                                 "doc_id long, text string, lang string")
    net = langid.fit(docs)
    got = langid.predict(docs, net).withColumn("out", langid.held_out(F.col("doc_id"))).collect()
    held = [r for r in got if r["out"] and r["doc_id"] < 900]
    assert held and np.mean([r["lang_pred"] == r["lang"] for r in held]) > 0.97
    assert {(r["lang_pred"], r["score"]) for r in got if r["doc_id"] >= 900} == {("und", 0.0)}
    assert langid.fit(docs.where("false")) is None
    assert {r["lang_pred"] for r in langid.predict(docs, None).collect()} == {"und"}
    one, _ = langid.predict_texts(net, ["abc " * 5000])
    assert net.classes[one[0]] == "aa"


def test_bpe_round_trip(spark):
    tokenizers = pytest.importorskip("tokenizers")
    public = pytest.importorskip("public_tokenizers")
    definition = bpe.load_definition(public.path("byte_bpe_50k.json"))
    plain = tokenizers.Tokenizer.from_str(definition)
    rng = random.Random(5)
    parts = ["a", "don't", " ", "  ", "\n", "\t", "<|endoftext|>", "<|", "é", "12", "!", " ", "　", "\u0085", "🙂", "中", "\x1c"]
    texts = [None, "", *["".join(rng.choice(parts) for _ in range(rng.randrange(1, 25))) for _ in range(300)]]
    rows = bpe.decode(bpe.encode(docs_of(spark, texts), definition), definition).collect()
    for r in rows:
        ids = plain.encode(texts[r["doc_id"]] or "", add_special_tokens=False).ids
        assert np.frombuffer(r["ids"], "<u4").tolist() == ids and r["n_tokens"] == len(ids)
        assert r["text"] == plain.decode(ids, skip_special_tokens=False)
    assert bpe.encode(docs_of(spark, texts).where("false"), definition).count() == 0
    assert hashlib.sha256(b"").hexdigest() == docs_of(spark, [None]).select(F.sha2(F.lit(b""), 256)).first()[0]


def test_nearest_neighbours(spark):
    rng = np.random.default_rng(3)
    vectors = [[float(x) for x in v] for v in rng.normal(size=(300, 8))]
    vectors[50:80] = [vectors[50]] * 30
    rows = list(enumerate(vectors)) + [(1000, None), (1001, [0.0] * 8), (1002, [float("nan")] * 8), (1003, [1.0, None] * 4),
                                       (1004, [1.0] * 5), (1005, [])]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    found = neighbours.search(table, F.col("vec_id") % 20 == 0, rounds=2, hops=2).collect()
    flat = np.array(vectors, dtype=np.float32).astype(np.float64)
    hit = 0
    for q in range(0, 300, 20):
        score = flat @ flat[q]
        order = sorted((i for i in range(300) if i != q), key=lambda i: (-score[i], i))[:20]
        mine = sorted((r for r in found if r["query_id"] == q), key=lambda r: r["rank"])
        assert [r["rank"] for r in mine] == list(range(1, 21))
        assert all(abs(r["score"] - score[r["vec_id"]]) < 1e-9 for r in mine)
        hit += len({r["vec_id"] for r in mine} & set(order))
    assert hit / (15 * 20) >= 0.95 and {r["query_id"] for r in found} == set(range(0, 300, 20))
    few = neighbours.search(table.where("vec_id in (0, 1, 2, 1000)"), F.col("vec_id") == 0, rounds=1, hops=1).collect()
    assert {r["vec_id"] for r in few} == {1, 2}
    assert neighbours.search(table.where("false"), F.col("vec_id") == 0, rounds=1, hops=1).count() == 0


@pytest.mark.parametrize("kind", ["lognormal", "outlier", "opposite"])
def test_nearest_neighbours_of_uneven_vectors(spark, kind):
    rng = np.random.default_rng(11)
    if kind == "opposite":
        made = np.ones((600, 6)) + rng.normal(size=(600, 6)) * 0.01
        made[:3] *= -1
    else:
        made = rng.normal(size=(600, 16))
        made /= np.linalg.norm(made, axis=1, keepdims=True)
        if kind == "lognormal":
            made *= rng.lognormal(size=(600, 1))
        else:
            made[7] *= 100
    table = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(made)], "vec_id long, embedding array<float>")
    found = neighbours.search(table, F.col("vec_id") % 20 == 0, rounds=3, hops=3).collect()
    flat = made.astype(np.float32).astype(np.float64)
    hit = 0
    for q in range(0, 600, 20):
        score = flat @ flat[q]
        order = sorted((i for i in range(600) if i != q), key=lambda i: (-score[i], i))[:20]
        mine = [r["vec_id"] for r in found if r["query_id"] == q]
        assert len(set(mine)) == 20
        hit += len(set(mine) & set(order))
    assert hit / (30 * 20) >= 0.9


def test_packing_is_best_fit_and_free_of_conflicts(spark):
    rng = random.Random(8)
    sizes = [rng.randrange(1, 60) for _ in range(200)]
    sources, clusters = [rng.choice("aaabc") for _ in sizes], [rng.randrange(40) for _ in sizes]
    placed = packing.pack_block(sizes, sources, clusters, 100)
    bins: list[list[int]] = []
    for i in sorted(range(200), key=lambda i: -sizes[i]):
        def room(b):
            return 100 - sum(sizes[j] for j in bins[b])
        fits = [b for b in range(len(bins)) if room(b) >= sizes[i] and all(
            sources[j] != sources[i] and clusters[j] != clusters[i] for j in bins[b])]
        at = min(fits, key=lambda b: (room(b), b)) if fits else len(bins)
        if at == len(bins):
            bins.append([])
        assert placed[i] == (at, sum(sizes[j] for j in bins[at]))
        bins[at].append(i)


def test_packing_keeps_every_word(spark, corpus):
    texts = [*corpus, " ".join(["w"] * 250)]
    rows = packing.pack(docs_of(spark, texts), capacity=100, block=20).collect()
    total = Counter()
    for r in rows:
        total[r["doc_id"]] += r["n_words"]
        assert 0 <= r["start"] and r["start"] + r["n_words"] <= 100
    assert total == Counter({i: len(WORD.findall(t or "")) for i, t in enumerate(texts)}) and len(total) == len(texts)
    by_bin = {}
    for r in rows:
        by_bin.setdefault(r["bin_id"], []).append(r)
    for group in by_bin.values():
        worded = [r["doc_id"] % 3 for r in group]
        assert len(worded) == len(set(worded))
        spans = sorted((r["start"], r["n_words"]) for r in group)
        assert all(a + n <= b for (a, n), (b, _) in zip(spans, spans[1:], strict=False))
    assert packing.pack(docs_of(spark, texts).where("false")).count() == 0


def test_quotes_link_replies(spark):
    rows = [(1, 0, "user", "How do I sort?\n\nAnd what about ties?"),
            (1, 1, "assistant", "> How do I sort?\nUse order by."),
            (1, 2, "assistant", "> And  what ABOUT ties?\nAdd a key."),
            (1, 3, "user", "> > How do I sort?\n> Use order by.\nThanks.\n\n> never said\nBye"),
            (1, 4, "user", "plain"), (2, 0, "user", None), (2, 1, "user", ""), (None, 0, "user", "x"), (1, None, "user", "x")]
    found = quotes.format_chats(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    by = {(r["conv_id"], r["turn"]): r for r in found}
    assert [by[1, t]["reply_to"] for t in range(5)] == [None, 0, 0, 1, 3]
    assert [by[1, t]["quoted"] for t in range(5)] == [False, True, True, True, False]
    assert [by[1, t]["position"] for t in range(5)] == [0, 1, 4, 2, 3]
    assert [by[1, t]["depth"] for t in range(5)] == [0, 1, 1, 2, 3]
    assert by[1, 3]["text"] == "Thanks.\n\nBye" and by[1, 1]["text"] == "Use order by."
    assert by[2, 0]["text"] == "" and len(found) == 7


PAGE = ("<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var a='</p>';</script></head><body>"
        "<nav><ul><li><a href=x>menu</a></li></ul></nav><div class='cookie-banner'>We use</div>{body}"
        "<div class=\"comments\"><p>nice</p></div><form><input>mail</form><footer>foot</footer></body></html>")


def test_wrappers_extract_main_text(spark):
    bodies = {1: "<article><h1>Head</h1><p>A &amp; B<br>c  d<p><b>E</b>f</article>", 2: "<article><h1>Other</h1><p>x</article>",
              3: "<div class=post><p>Body three of it</p></div><div class=box>Same everywhere</div>",
              4: "<div class=post><p>Body four</p></div><div class=box>Same everywhere</div>",
              5: "<div class=post><p>Body five <a href=x>y</a></p><!-- <p>no</p> --></div><div class=box>Same everywhere</div>"}
    rows = [(i, f"http://{'h' if i < 3 else 'g'}.org/{i}", PAGE.replace("{body}", b)) for i, b in bodies.items()]
    rows += [(6, None, None), (7, "http://g.org/7", ""), (8, "http://h.org/8", "<p>cut <a hre")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    text = {r["page_id"]: r["text"] for r in wrappers.extract(pages).collect()}
    assert text == {1: "Head A & B c d Ef", 2: "Other x", 3: "Body three of it", 4: "Body four", 5: "Body five y",
                    6: "", 7: "", 8: "cut"}
    made = {r["host"]: r for r in wrappers.wrappers(pages).collect()}
    assert "p(# )+" in made["h.org"]["wrapper"] and made["g.org"]["pages"] == 4
    assert wrappers.extract(pages.where("false")).count() == 0


def test_alignment_makes_optional_and_repeated_groups():
    def tree(source):
        return wrappers.shape(list(wrappers.read(source)))
    one, two = tree("<div><h2>a</h2><p>b</p><p>c</p></div>"), tree("<div><p>b</p><section>d</section></div>")
    both = "".join(p.write() for p in wrappers.aligned(one.parts, two.parts))
    assert both == "div(h2(# )? p(# )+ section(# )? ) "
    assert "".join(p.write() for p in wrappers.parsed(both).parts) == both


def test_wrapper_places_decide_the_content(spark):
    def page(i, extra=""):
        return (f"<body><div><p>Fixed line</p></div><section><h2>head {i}</h2></section><div><p>Body {i} text</p></div>{extra}"
                "<section><h2>Most read</h2></section></body>")
    rows = [(i, f"http://k.org/{i}", page(i, "<pre>x</pre>" * (i % 2))) for i in range(6)]
    rows += [(10 + i, f"http://big.org/{i}", page(i, "".join(f"<{t}>{t} {i}</{t}>" for k, t in enumerate(("pre", "h3", "h4", "h5"))
                                                            if i >> k & 1))) for i in range(16)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    for fan in (2, 64):
        text = {r["page_id"]: r["text"] for r in wrappers.extract(pages, fan).collect()}
        assert all(text[i] == f"head {i} Body {i} text" for i in (0, 2, 4))
        assert all(text[10 + i].startswith(f"head {i} Body {i} text") for i in range(16))
        assert not any("Fixed" in t or "Most" in t for t in text.values())
        assert text[25] == "head 15 Body 15 text pre 15 h3 15 h4 15 h5 15"
    made = {r["host"]: r for r in wrappers.infer_wrappers(wrappers.read_pages(pages), 2).collect()}
    assert sorted(made) == ["big.org", "k.org"] and made["big.org"]["pages"] == 16


def test_pipeline_runs_end_to_end(spark):
    rows = corpus_pipeline.run(spark, "/root/testdata/sf0.001").collect()
    assert rows and {"doc_id", "bin_id", "n_words", "start"} <= set(rows[0].asDict())
