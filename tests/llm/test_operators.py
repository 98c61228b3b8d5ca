"""Each operator against a plain Python version, on texts with the awkward cases."""

from __future__ import annotations

import itertools
import math
import random
import re
import types
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from rosterline.session import path_exists
from rosterline.llm import common, kd_shards, licenses, mixing, packing, preference, quality_rules, queries, simhash, templates, top_k, toxicity

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, `row` string, size int, key string, score int"


def rows_of(seed=1, n=120):
    """Documents with nulls, empty and long texts, copies, near copies, repeated rows and clashing columns."""
    draw = random.Random(seed)
    words = ["alpha", "Beta", "gamma,", "DELTA", "epsilon", "zeta#", "été", "the", "of", "mit", "license", "apache"]
    texts = [" ".join(draw.choice(words) for _ in range(draw.choice([1, 2, 5, 30, 90]))) for _ in range(n)]
    texts[3:6] = [None, "", " \n\t "]
    texts[6] = "mit license under the Apache License, and MIT\nlicense " + texts[7]
    texts[8] = " ".join(texts[9:60:2])
    texts[20:40] = [texts[19] + " " + texts[19]] * 20
    lines = "one line here\nanother line\none line here\n" + "x y z a b c d e f " * 6
    texts[41] = lines
    rows = [(i, t, [None, "en", "fr"][i % 3], [None, "a", "b", "b", "b"][i % 5], len(t or ""), "r", 1, "k", 2) for i, t in enumerate(texts)]
    rows += [rows[9], rows[9], (None, "null id text here", "en", "a", 3, None, None, None, None)]
    return rows


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(rows_of(), SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def by_row(df, *columns):
    return Counter(tuple(row[c] for c in columns) for row in df.collect())


def test_measures(docs, none):
    def plain(text):
        words = re.findall(common.WORD, text or "")
        windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
        often = Counter(windows)
        covered = {j for i, w in enumerate(windows) if often[w] > 1 for j in range(i, i + 8)}
        lines = [line for line in (text or "").split("\n") if re.search(common.WORD, line)]
        return (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(covered))

    out = quality_rules.quality_rules(docs)
    want = Counter((r[0], *plain(r[1])) for r in rows_of())
    assert by_row(out, "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words") == want
    for row in out.collect():
        assert row["base_failed"] == (row["n_words"] < 20 or 100 * row["n_repeat_words"] > 30 * row["n_words"])
        assert not (row["base_failed"] and row["kept"])
    assert out.filter("kept").count() > 0
    assert quality_rules.quality_rules(none).count() == 0


def test_adaptive_limits_follow_the_group(spark):
    clean = [(i, " ".join(["word" if (i + j) % 3 else "longer"] + [f"w{i}x{j}"])) for i in range(300) for j in [0]]
    rows = [(i, " ".join(f"{t[1]}{k}" for k in range(30)), "en", "s", 0, "", 0, "", 0) for i, t in enumerate(clean)]
    rows.append((999, " ".join(f"##{k}$$%%" for k in range(40)), "en", "s", 0, "", 0, "", 0))
    out = {r["doc_id"]: r["kept"] for r in quality_rules.quality_rules(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert not out.pop(999) and all(out.values())


def test_small_groups_have_limits_of_their_own(spark):
    def text(word, i):
        return " ".join(f"{word}{i:03d}x{j:02d}" for j in range(30))

    hot = [(i, text("w", i), "en", "hot", 0, "", 0, "", 0) for i in range(400)]
    small = [(1000 + i, text("averyveryverylongword", i), "en", "small", 0, "", 0, "", 0) for i in range(8)]
    odd = [(2000, text("w", 0), "en", "small", 0, "", 0, "", 0), (2001, text("averyveryverylongword", 0), "en", "hot", 0, "", 0, "", 0)]
    judged = lambda rows: {r["doc_id"]: r["kept"] for r in quality_rules.quality_rules(spark.createDataFrame(rows, SCHEMA)).collect()}
    out = judged(hot + small + odd)
    assert [i for i, kept in out.items() if not kept] == [2000, 2001]
    # Growing another group changes no verdict.
    assert {i: kept for i, kept in judged(small + odd[:1]).items()} == {i: out[i] for i in [*range(1000, 1008), 2000]}


def test_mix(docs, none):
    out = mixing.mix(docs).collect()
    sizes = [(r[0], len(re.findall(common.WORD, r[1] or "")), r[3]) for r in rows_of()]
    totals = defaultdict(int)
    for _, size, source in sizes:
        totals[source] += size
    order = sorted(totals, key=lambda s: (s is None, s or ""))
    weights = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    target, left, open_ = {}, 1.5 * sum(totals.values()), list(order)
    while True:
        per = left / sum(weights[s] for s in open_)
        over = [s for s in open_ if weights[s] * per > 2 * totals[s]]
        if not over:
            target |= {s: weights[s] * per for s in open_}
            break
        for s in over:
            target[s] = 2.0 * totals[s]
            left -= target[s]
            open_.remove(s)
    assert Counter((r["doc_id"], r["size"], r["source_size"]) for r in out) == Counter((d, n, totals[s]) for d, n, s in sizes)
    taken, wanted = Counter(), {}
    for r in out:
        taken[r["source_size"]] += r["taken"]
        wanted[r["source_size"]] = r["target"]
        assert 0 <= r["taken"] <= 2 * r["size"]
    for source, total in totals.items():
        assert wanted[total] == pytest.approx(target[source]) and taken[total] == int(wanted[total])
    assert by_row(mixing.mix(docs), "doc_id", "taken") == by_row(mixing.mix(docs.repartition(5)), "doc_id", "taken")
    assert mixing.mix(none).count() == 0 and mixing.mixed_documents(none).count() == 0
    copies = mixing.mixed_documents(docs)
    assert copies.columns == docs.columns
    words = copies.select(F.sum(F.regexp_count("text", F.lit(common.WORD)))).first()[0]
    assert words == sum(r["taken"] for r in out)


def test_pack(docs, none):
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(queries.word_bpe())
    pieces = packing.pack(docs, queries.word_bpe(), window=64).collect()
    want = Counter()
    for r in rows_of():
        ids = np.array([*model.encode(r[1] or "", add_special_tokens=False).ids, 1], "<u4")
        want[r[0], len(ids)] += len(ids)
    got, windows = Counter(), defaultdict(list)
    texts = defaultdict(list)
    for r in rows_of():
        texts[r[0]] = np.array([*model.encode(r[1] or "", add_special_tokens=False).ids, 1], "<u4")
    for p in pieces:
        got[p["doc_id"], p["doc_tokens"]] += p["length"]
        windows[p["sequence_id"]].append((p["offset"], p["length"], p["source"]))
        assert p["ids_crc32"] == zlib.crc32(texts[p["doc_id"]][p["start"] : p["start"] + p["length"]].tobytes())
    assert got == want
    total = sum(want.values())
    assert sorted(windows) == list(range(-(-total // 64)))
    share = Counter()
    for r in rows_of():
        share[r[3]] += len(texts[r[0]]) / total
    for number, parts in windows.items():
        end = 0
        for offset, length, _ in sorted(parts, key=lambda part: part[:2]):
            assert offset == end
            end += length
        assert end == (64 if number < len(windows) - 1 else total - 64 * number)
        for source, part in share.items():
            if end == 64:
                assert abs(sum(n for _, n, s in parts if s == source) - part * 64) <= 3
    assert packing.pack(none, queries.word_bpe()).count() == 0


def test_histograms_count_every_score():
    """Counts of two tasks add up to those of all scores, however wide their range."""
    draw = np.random.default_rng(5)
    for scale in (3, 40, 3000, 10**6):
        matrix = draw.integers(-scale, scale, (90, 4))
        rows = [(i, row.tolist()) for i, row in enumerate(matrix)]
        norms = {4: float(np.sqrt((matrix.astype(float) ** 2).sum(axis=1).max()))}
        some = rows[:6]
        scores = np.array([sorted((int(matrix[q] @ matrix[c]) for c in range(90) if c != q), reverse=True) for q in range(6)])
        low, shift = top_k._first_ranges(some, norms)
        high = np.full(6, top_k.BINS)
        counted = Counter()
        for part in (rows[:40], rows[40:]):
            batch = pa.RecordBatch.from_pydict({"vec_id": [i for i, _ in part], "v": [v for _, v in part]})
            holder = types.SimpleNamespace(value=some), types.SimpleNamespace(value=(low, shift, high))
            for out in top_k._histograms(*holder, 10**6)([batch]):
                for row in out.to_pylist():
                    counted[row["place"], row["bin"]] += row["n"]
        want = Counter((q, (int(s) - int(low[q])) >> int(shift[q])) for q in range(6) for s in scores[q])
        assert counted == want and sum(counted.values()) == 6 * 89


def test_top_k(spark, monkeypatch):
    draw = np.random.default_rng(3)
    rows = [(i, [float(x) for x in draw.normal(0, 0.3, 6).astype("float32")]) for i in range(300)]
    rows += [(300 + i, rows[0][1]) for i in range(40)]  # ties
    rows += [(400, None), (450, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (500, [float("nan")] * 6), (None, [1.0] * 6), (7, rows[7][1]), (550, [])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(4)
    out = top_k.top_k(top_k.whole_vectors(df), F.col("vec_id") % 50 == 0)
    ok = [(i, np.floor(256 * np.array(v, dtype="float32").astype(float)).astype(int)) for i, v in rows if i is not None and v and None not in v and np.isfinite(v).all()]
    want = set()
    for q, v in ok:
        if q % 50 == 0:
            best = sorted((-int(v @ c), i) for i, c in ok if i != q)[:5]
            want |= {(q, rank, i, -s) for rank, (s, i) in enumerate(best, 1)}
    assert {tuple(r) for r in out.select("query_id", "rank", "vec_id", "score").collect()} == want
    monkeypatch.setattr(top_k, "QUERY_BLOCK", 3)  # several blocks; plans do not grow with them
    blocks = top_k.top_k(top_k.whole_vectors(df), F.col("vec_id") % 50 == 0)
    assert {tuple(r) for r in blocks.select("query_id", "rank", "vec_id", "score").collect()} == want
    assert "Union" not in blocks._jdf.queryExecution().toString()
    few = df.filter("vec_id in (0, 1, 2)")
    assert top_k.top_k(top_k.whole_vectors(few), F.col("vec_id") % 50 == 0).count() == 2
    assert top_k.top_k(top_k.whole_vectors(df.filter("false")), F.col("vec_id") % 50 == 0).count() == 0


def test_classifiers(docs, none, spark):
    labels = spark.createDataFrame([(i, int(i % 2), int(i % 2)) for i in range(120)] + [(None, 1, 1), (5, None, None)], "doc_id long, quality int, toxic int")
    for scores, cut in ((preference.preference_scores, 0.7), (toxicity.toxicity_scores, 0.5)):
        out = scores(docs, labels).collect()
        assert len(out) == len(rows_of())
        for row in out:
            assert 0 <= row["score"] <= 1 and row["predicted"] == int(row["score"] >= cut) and row["held_out"] is not None
        assert scores(none, labels).count() == 0
        assert scores(docs, labels.filter("false")).count() == len(rows_of())
    parts = {r["doc_id"]: r["held_out"] for r in toxicity.toxicity_scores(docs, labels).collect()}
    assert all(out == (zlib.crc32(str(i).encode()) % 5 == 0) for i, out in parts.items() if i is not None)


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    labels = common.read(spark, sf, "labels")
    for query, label, floor in ((queries.op5_pairwise_quality, "quality", 0.9), (queries.op8_toxicity, "toxic", 0.9)):
        known = query(spark, sf).filter("held_out").join(labels, "doc_id").select("predicted", label).collect()
        right = sum(row["predicted"] == row[label] for row in known) / len(known)
        assert right >= floor, (label, right)


def test_shards(docs, none):
    out = kd_shards.kd_shards(docs, shards=16).collect()
    want = Counter((r[0], len((r[1] or "").encode()) + 1, zlib.crc32((r[1] or "").encode())) for r in rows_of())
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in out) == want
    shards = defaultdict(list)
    for row in out:
        shards[row["shard"]].append(row)
    most = max(row["size"] for row in out)
    mean = sum(row["size"] for row in out) / 16
    for shard in shards.values():
        assert sorted(row["slot"] for row in shard) == list(range(len(shard)))
        assert abs(sum(row["size"] for row in shard) - mean) <= 2 * most
    assert set(shards) <= set(range(16))
    assert kd_shards.kd_shards(none, shards=16).count() == 0
    small = kd_shards.kd_shards(docs, target_bytes=mean * 4).groupBy("shard").count().count()
    assert small == 4


def test_licenses(docs, none, spark):
    def plain(text):
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
        hits = [(i, label) for phrase, label in licenses.BASE_PHRASES.items() for i in range(len(words)) if words[i : i + len(phrase.split())] == phrase.split()]
        starts = [i for i, _ in hits]
        return len(words), len(hits), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for _, x in hits}))

    out = licenses.license_scan(docs)
    assert by_row(out, "doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels") == Counter((r[0], *plain(r[1])) for r in rows_of())
    for row in out.collect():
        assert set(row["base_labels"].split(",")) - {""} <= set(row["labels"].split(",")) and 0 <= row["score"] <= 1
    text = "intro words. " + licenses.TEMPLATES["bsd"][0].title().replace(" Provided ", " PROVIDED, ") + " more " * 30
    changed = text.replace("Source And Binary", "source or binary")
    found = licenses.license_scan(spark.createDataFrame([(1, text), (2, changed)], "doc_id long, text string")).collect()
    assert {row["doc_id"]: row["labels"] for row in found} == {1: "bsd", 2: ""}
    assert licenses.license_scan(none).count() == 0


def test_one_repeated_row_is_cut_apart(spark):
    rows = [(7, "the same text")] * 400 + [(i, f"text of its own {i}") for i in range(1000, 1400)]
    rows = [(*row, "a", "en") for row in [*rows, *[(None, "no id")] * 400]]
    out = kd_shards.kd_shards(spark.createDataFrame(rows, "doc_id long, text string, source string, lang string"), shards=4).collect()
    of = Counter()
    for row in out:
        of[row["shard"]] += row["size"]
    mean = sum(of.values()) / 4
    assert all(abs(size - mean) <= 0.02 * mean for size in of.values()) and len(of) == 4


def scanned(text):
    """The labels that one text has, without Spark; every word is equally rare."""
    words = licenses.words_of(text)
    found = [(word, at) for at, word in enumerate(words) if word in licenses.VOCABULARY]
    postings = licenses.anchors({word: 1.0 for word in licenses.VOCABULARY})
    return set(licenses.scan([w for w, _ in found], [at for _, at in found], postings)[4].split(",")) - {""}


def test_every_notice_of_a_file_is_found(spark):
    every = {label: text for label, (text, _) in licenses.TEMPLATES.items()}
    assert scanned(" and so on ".join(every.values())) == set(every)
    rows = [(1, " x ".join(every.values())), *((i + 2, f"the of and to {i}") for i in range(20))]
    found = licenses.license_scan(spark.createDataFrame(rows, "doc_id long, text string")).filter("doc_id = 1").first()
    assert set(found["labels"].split(",")) == set(every) and found["score"] == 1.0
    for a, b, c in itertools.permutations(every, 3):
        assert {a, b, c} <= scanned(" x ".join([every[a], every[b], every[c]]))


def test_notices_with_words_more_or_less():
    for label, (text, phrases) in licenses.TEMPLATES.items():
        words = text.split()
        for at in range(1, len(words)):
            for changed in ([*words[:at], "extra", *words[at:]], [*words[: at - 1], *words[at:]]):
                whole = " ".join(changed)
                stands = all(f" {phrase} " in f" {whole} " for phrase in phrases)
                base = {name for phrase, name in licenses.BASE_PHRASES.items() if phrase in whole}
                assert (label in scanned(f"a b c {whole} d")) == (stands or label in base), whole
    usual = licenses.TEMPLATES["lgpl"][0].replace("terms of the gnu", "terms of version 2.1 of the gnu")
    assert "lgpl" in scanned(usual)
    words = licenses.TEMPLATES["isc"][0].split()
    lines = [" ".join(words[i : i + 11]) for i in range(0, len(words), 11)]
    assert scanned("\n".join(f"rem {line}" for line in lines)) == {"isc"}
    shuffled = licenses.TEMPLATES["bsd"][1][0] + " " + " ".join(reversed(licenses.TEMPLATES["bsd"][0].split()[8:]))
    assert scanned(shuffled) == set()


PAGE = """<!DOCTYPE html><html><head><title>T</title><script>var t="</p>";</script></head><body><nav><ul><li><a>menu {0}</a></ul></nav>
<!-- ad --><div class="ad">Buy {0}</div>{1}<div class="comments"><p>first!</div><footer>&copy; foot</footer></body></html>"""


def test_main_text(spark):
    article = "<article><h1>Head&amp;line {0}</h1><p><b>bo</b>ld\n text<br><p>Same on all pages.</p></article>"
    rows = [(i, f"http://h.example/{i}", PAGE.format(i, article.format(i)), "x", 1) for i in range(6)]
    plain = "<div class='wrap'><p>Body {0} of page</p></div><div class='box'>All alike here</div>"
    rows += [(10 + i, f"http://g.example/{i}", PAGE.format(i, plain.format(i)), "x", 1) for i in range(4)]
    rows += [(20, None, None, "x", 1), (21, "u", "", None, None), (22, "http://one.example/", "<p>cut &lt;off", "x", 1)]
    out = {r["page_id"]: r["text"] for r in templates.main_text(spark.createDataFrame(rows, "page_id long, url string, html string, text string, blocks int")).collect()}
    for i in range(6):
        assert out[i] == f"Head&line {i} bold text Same on all pages."
    for i in range(4):
        assert out[10 + i] == f"Body {i} of page"
    assert out[20] == out[21] == "" and out[22] == "cut <off"
    assert templates.main_text(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def texts_of(spark, pages):
    rows = [(i, f"http://h.example/{i}", page) for i, page in enumerate(pages)]
    out = templates.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    return {row["page_id"]: row["text"] for row in out}


def test_template_of_pages_without_article(spark):
    # The footer and the box come behind bodies of several lengths; one block of a region that else varies is fixed.
    bodies = [[f"Body {i} has words that no other page has, line {k}" for k in range(i + 1)] for i in range(5)]
    pages = [
        "<div class='wrap'><p>Fixed lead</p>" + "".join(f"<p>{line}</p>" for line in body) + "</div>"
        "<div class='box'>All alike here</div><div class='low'>Imprint</div>" for body in bodies
    ]
    assert texts_of(spark, pages) == {i: " ".join(body) for i, body in enumerate(bodies)}


def test_template_decides_and_names_break_ties(spark):
    # The main text stands in a region named like a widget; the article holds a short teaser.
    long = [f"Text {i} " + " ".join(f"word{i}x{k}" for k in range(60)) for i in range(4)]
    pages = [f"<div class='widget'><p>{text}</p></div><article><p>See {i}</p></article>" for i, text in enumerate(long)]
    assert texts_of(spark, pages) == {i: f"{text} See {i}" for i, text in enumerate(long)}
    assert texts_of(spark, pages[:1]) == {0: "See 0"}


def test_ids_of_single_pages_do_not_hide_the_template(spark):
    page = "<div id='{0}' class='post-{0} text'><p>Fixed lead</p><p>{1}</p><div id='box-{0}'>All alike here</div></div>"
    own = [f"Page {i} has words of its own" for i in range(4)]
    names = ["first-things", "second", "third-a", "fourth"]
    assert texts_of(spark, [page.format(name, text).replace("post-" + name, f"post-{i}") for i, (name, text) in enumerate(zip(names, own))]) == dict(enumerate(own))
    paths = {token[0] for i in range(50) for token in templates.page_tokens(page.format(i, own[0]))}
    assert len(paths) == 3
    assert templates.page_tokens("<div id='sidebar'>x</div>")[-1][3] == 0


def test_classes_are_ordered_and_nested():
    of = lambda *tokens: [{"vector": v, "own": v, "part": 0, "tok": t, "size": m, "pages": n} for v, t, m, n in tokens]
    assert [each[3] for each in templates.order_of(of((1, 5, 2, 9), (1, 6, 2, 9), (1, 5, 2, 9), (1, 6, 2, 9)))] == [True, True]
    assert [each[3] for each in templates.order_of(of((1, 5, 2, 9), (1, 6, 2, 9), (1, 6, 2, 9), (1, 5, 2, 9)))] == [False, False]
    inside = templates.nest_of(of((1, 5, 2, 9), (2, 7, 2, 4), (2, 8, 2, 4), (1, 6, 2, 9)))
    assert all(holds for *_, holds in inside) and len({place for _, _, place, _ in inside}) == 2
    mixed = templates.nest_of(of((1, 5, 2, 9), (2, 7, 2, 4), (1, 6, 2, 9), (2, 8, 2, 4)))
    assert {vector: holds for vector, _, _, holds in mixed} == {1: True, 2: False}


def components_of(prints):
    parent = {p: p for p in prints}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    listed = sorted(parent)
    for i, a in enumerate(listed):
        for b in listed[:i]:
            if bin(a ^ b).count("1") <= 3:
                parent[find(a)] = find(b)
    groups = defaultdict(set)
    for p in parent:
        groups[find(p)].add(p)
    return {frozenset(group) for group in groups.values() if len(group) > 1}


@pytest.mark.parametrize("crowd", [4, 128])
def test_links_keep_components(spark, monkeypatch, crowd):
    monkeypatch.setattr(simhash, "CROWD", crowd)
    draw = random.Random(5)
    prints = set()
    for _ in range(12):
        base = draw.getrandbits(64)
        for _ in range(25):
            changed = base
            for bit in draw.sample(range(64), draw.randint(0, 5)) if draw.random() < 0.5 else draw.sample(range(32), draw.randint(0, 4)):
                changed ^= 1 << bit
            prints.add(changed - (1 << 64) if changed >> 63 else changed)
    roots = simhash.components(simhash.links(spark.createDataFrame([(p,) for p in prints], "fp long")))
    groups = defaultdict(set)
    for row in roots.collect():
        groups[row["root"]].add(row["node"] & (2**64 - 1))
    assert {frozenset(g) for g in groups.values()} == components_of({p & (2**64 - 1) for p in prints})


def test_links_broadcast_nothing_exploded(spark, monkeypatch):
    monkeypatch.setattr(simhash, "CROWD", 4)
    monkeypatch.setattr(simhash, "FEW", 100, raising=False)
    draw = random.Random(6)
    prints = {draw.getrandbits(63) for _ in range(500)} | {(7 << 32) ^ (1 << i) ^ (1 << j) for i in range(20) for j in range(i)}
    links = simhash.links(common.staged(spark.createDataFrame([(p,) for p in prints], "fp long"), "prints"))
    groups = defaultdict(set)
    for row in simhash.components(links).collect():
        groups[row["root"]].add(row["node"])
    assert {frozenset(g) for g in groups.values()} == components_of(prints)
    links.collect()
    lines = links._jdf.queryExecution().executedPlan().toString().splitlines()  # the plan as run, and as first made
    depth = [len(re.match(r"[\s:+*-]*", line).group()) for line in lines]
    assert any("Generate" in line for line in lines)
    for i, line in enumerate(lines):
        if "BroadcastExchange" in line:
            below = itertools.takewhile(lambda k: depth[k] > depth[i], range(i + 1, len(lines)))
            assert not any("Generate" in lines[k] for k in below)


def test_near_duplicates(docs, none):
    def plain(text):
        words = re.findall(common.WORD, "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
        parts = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
        hashes = [xxhash.xxh64_intdigest(p.encode(), 42) for p in parts]
        return sum(1 << bit for bit in range(64) if 2 * sum(h >> bit & 1 for h in hashes) > len(hashes)) if hashes else 0

    prints = [(r[0], plain(r[1])) for r in rows_of()]
    groups = components_of({p for _, p in prints})
    of = {p: min(d for d, q in prints if d is not None and q in next((g for g in groups if p in g), {p})) if any(d is not None and q in next((g for g in groups if p in g), {p}) for d, q in prints) else None for _, p in prints}
    out = simhash.near_duplicates(docs)
    assert by_row(out, "doc_id", "fingerprint", "component_id") == Counter((d, f"{p:016x}", of[p]) for d, p in prints)
    assert out.filter("first").count() == len({of[p] if of[p] is not None else p for _, p in prints})
    assert simhash.near_duplicates(none).count() == 0


def test_shingle_hash_is_sparks(spark):
    texts = ["a b c", "été zwei drei"]
    got = [r[0] & (2**64 - 1) for r in spark.createDataFrame([(t,) for t in texts], "t string").select(F.xxhash64("t")).collect()]
    assert got == [xxhash.xxh64_intdigest(t.encode(), 42) for t in texts]


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_sql(spark, name):
    sf = "/root/testdata/sf0.01"
    con = duckdb.connect()
    for table in ("documents", "embeddings"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{sf}/{table}.parquet'")
    cursor = con.execute(queries.SQL[name])
    names = [each[0] for each in cursor.description]
    want = Counter(cursor.fetchall())
    assert by_row(queries.QUERIES[name](spark, sf), *names) == want


def test_pipeline_stages(spark, docs, none):
    sf = "/root/testdata/sf0.001"
    kept = docs
    for name, stage in corpus_pipeline.STAGES:
        out = common.staged(stage(spark, kept, sf), "stage")
        if name != "packing":
            assert out.columns == docs.columns
        kept = out
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, none, sf).count() == 0


def test_pipeline_run_against_plain_python(spark, tmp_path):
    """All five stages on a fixture; each is judged on what the one before it really kept."""
    rows = [(i, f"{text} " + " ".join(f"w{i}x{j}" for j in range(25)) if i is None or i % 7 else text, lang, source, n) for i, text, lang, source, n, *_ in rows_of() if text is not None]
    ids = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(rows, ids).repartition(2).write.parquet(f"{tmp_path}/documents.parquet")
    labels = [(i, i % 2, int(i % 9 == 0)) for i in range(100)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs, seen = spark.read.parquet(f"{tmp_path}/documents.parquet"), {}
    before = docs
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, before, str(tmp_path))
        out.write.parquet(f"{tmp_path}/{name}")
        seen[name] = before = spark.read.parquet(f"{tmp_path}/{name}")
    taken = lambda df: Counter(tuple(row) for row in df.collect())
    scores = toxicity.toxicity_scores(docs, spark.read.parquet(f"{tmp_path}/labels.parquet"), keep_row=True)
    assert taken(seen["toxicity"]) == taken(scores.filter("predicted = 0").select("row.*"))

    # Near-duplicates: union-find over all pairs of what the rules kept.
    kept = [tuple(row) for row in seen["quality rules"].collect()]
    prints = [simhash.fingerprint(row[1]) & (2**64 - 1) for row in kept]
    root = list(range(len(kept)))

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for a, b in itertools.combinations(range(len(kept)), 2):
        if (prints[a] ^ prints[b]).bit_count() <= 3:
            root[find(a)] = find(b)
    groups = defaultdict(list)
    for at, row in enumerate(kept):
        groups[find(at)].append((row[0] is None, row[0] or 0, row))
    left = seen["simhash near-dedup"].collect()
    assert sorted((row["doc_id"] is None, row["doc_id"] or 0) for row in left) == sorted(min(each)[:2] for each in groups.values())

    # The mix: per source whole epochs and one cut document, as the operator says.
    plan = {row["doc_id"]: row for row in mixing.mix(seen["simhash near-dedup"]).collect()}
    words = Counter()
    for row in seen["mixing sources"].collect():
        words[row["doc_id"]] += len(re.findall(common.WORD, row["text"]))
    assert dict(words) == {i: row["taken"] for i, row in plan.items() if row["taken"]}

    # Packing: all ids of every text, cut freely, in gapless sequences.
    whole = packing._tokenizer(queries.word_bpe()).model
    ids = Counter()
    for row in seen["mixing sources"].collect():
        ids[row["doc_id"]] += len(whole.encode(row["text"], add_special_tokens=False).ids) + 1
    pieces, places = Counter(), defaultdict(list)
    for row in seen["packing"].collect():
        pieces[row["doc_id"]] += row["length"]
        places[row["sequence_id"]].append((row["offset"], row["length"]))
    assert pieces == ids
    for sequence in places.values():
        at = 0
        for offset, length in sorted(sequence):
            assert offset == at
            at += length
        assert at <= packing.WINDOW
    assert taken(corpus_pipeline.run(spark, str(tmp_path))) == taken(seen["packing"])


def test_pipeline_keeps_one_stages_intermediate_tables(spark, docs):
    first = common.staged(corpus_pipeline.keep_quality(spark, docs, "/root/testdata/sf0.001"), "result")
    paths = list(corpus_pipeline._left[next(iter(corpus_pipeline._left))])
    assert paths and all(path_exists(spark, path) for path in paths)
    lazy = corpus_pipeline.drop_near_duplicates(spark, first, "/root/testdata/sf0.001")
    assert not any(path_exists(spark, path) for path in paths)
    mixed = corpus_pipeline.mix_sources(spark, lazy, "/root/testdata/sf0.001")  # reads what the stage before staged
    assert mixed.count() > 0


def test_samples_are_bounded_when_an_id_repeats(spark):
    rows = [(1, f"text {i % 7} of one id", "en", "s") for i in range(5000)] + [(i, f"words of document {i}", "en", "s") for i in range(2, 60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(1, 60)] + [(1, 0)], "doc_id long, quality int")
    sample = preference.training_rows(docs, labels, "quality", 4, 2, 60)
    kept = preference.bounded(sample, 10, "text").collect()
    assert Counter(row["y"] for row in kept) == {0: 10, 1: 10}
    assert sorted(map(tuple, kept)) == sorted(map(tuple, preference.bounded(sample.repartition(5), 10, "text").collect()))


def test_shards_of_text_ids(spark):
    names = ["abc", "7", "nan", "1e400", "", None, "id-3", "2.5"] * 40
    docs = spark.createDataFrame([(name, f"text {i}", "en", "s") for i, name in enumerate(names)], "doc_id string, text string, lang string, source string")
    out = kd_shards.kd_shards(docs, shards=4).collect()
    sizes = Counter()
    for row in out:
        sizes[row["shard"]] += row["size"]
    assert len(out) == len(names) and set(sizes) == {0, 1, 2, 3} and max(sizes.values()) - min(sizes.values()) <= 20


def test_quality_limits_against_plain_python(spark, docs):
    rules = {
        "word_length": (lambda m: 1000 * m[1] // max(m[0], 1), 8, None, True), "symbols": (lambda m: 1000 * m[2] // max(m[1], 1), 3, (1, 5), False),
        "dup_lines": (lambda m: 1000 * m[3] // max(m[0], 1), 3, (0, 3), False), "repeats": (lambda m: 1000 * m[4] // max(m[0], 1), 3, (0, 16), False),
    }
    coarse = lambda v: v >> max(0, v.bit_length() - 7) << max(0, v.bit_length() - 7)

    def quartiles(values):
        ordered = sorted(map(coarse, values))
        return [ordered[-(-part * len(ordered) // 4) - 1] for part in (1, 2, 3)]

    rows = rows_of() + [(3000 + i, text, lang, source, 0, "r", 0, "k", 0) for i, (_, text, lang, source, *_) in enumerate(rows_of(seed=9, n=200))]
    measured = [(r[0], r[2], r[3], quality_rules.measure_text(r[1])) for r in rows]
    passing = [m for m in measured if not (m[3][0] < 20 or 100 * m[3][4] > 30 * m[3][0])]
    groups = defaultdict(list)
    for _, lang, source, m in passing:
        groups[lang, source].append(m)

    def kept(lang, source, m):
        if m[0] < 20 or 100 * m[4] > 30 * m[0]:
            return False
        for value, reach, size, low_too in rules.values():
            low, _, high = quartiles(map(value, groups[lang, source]))
            spread = max(high - low, 1 << max(0, high.bit_length() - 7)) * (1 + 2 / math.sqrt(len(groups[lang, source])))
            if size:
                spread = max(spread, 1000 * size[1] / max(quartiles(each[size[0]] for each in groups[lang, source])[1], 1))
            if value(m) > high + int(reach * spread) or low_too and value(m) < low - int(reach * spread):
                return False
        return True

    out = quality_rules.quality_rules(spark.createDataFrame(rows, SCHEMA).repartition(3))
    want = Counter((i, m[0], kept(lang, source, m)) for i, lang, source, m in measured)
    assert by_row(out, "doc_id", "n_words", "kept") == want
    assert {kept for *_, kept in want} == {True, False}


def test_limits_differ_between_groups(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    failed = F.expr("m.n_words < 20 or 100 * m.n_repeat_words > 30 * m.n_words")
    measured = docs.select(common.group_key("lang").alias("lang_key"), common.group_key("source").alias("source_key"), quality_rules.measures(F.col("text")).alias("m"))
    limits = quality_rules.thresholds(measured.withColumn("base_failed", failed)).collect()
    for name in quality_rules.RULES:
        assert len({row[f"{name}_most"] for row in limits}) > 1


def test_preferences_are_fitted_on_all_pairs(spark):
    draw = np.random.default_rng(3)
    y = np.arange(200) % 2
    x = draw.normal(size=(200, preference.FEATURES)) + 0.4 * y[:, None] * (np.arange(preference.FEATURES) < 3)
    rows = spark.createDataFrame([(int(label), values.tolist()) for label, values in zip(y, x)], "y long, x array<double>")
    mean, spread = preference.spread_of(rows)
    assert np.allclose(mean, x.mean(axis=0), atol=1e-5) and np.allclose(spread, x.std(axis=0), atol=1e-5)
    weights = preference.fit_pairs(rows.repartition(3), mean, spread)
    z = x / x.std(axis=0)
    apart = (z[y == 1][:, None, :] - z[y == 0][None, :, :]).reshape(-1, preference.FEATURES)
    gradient = -(apart * (1 / (1 + np.exp(apart @ weights)))[:, None]).mean(axis=0) + 1e-3 * weights
    assert np.abs(gradient).max() < 2e-3 < 0.05 < np.abs(apart.mean(axis=0) / 2).max()


def test_preferences_learn_from_rows_past_the_first_20000(spark):
    ids = spark.range(27_500).select(F.col("id").alias("doc_id")).filter(~preference.held_out(F.col("doc_id"), 4, 2))
    order = [row[0] for row in ids.orderBy(F.xxhash64(F.col("doc_id").cast("string")), "doc_id").collect()]
    assert len(order) > 20_300
    texts = ["the town has a long street of shops", "# | # the town # has # a | # street", "THE TOWN HAS A LONG STREET OF SHOPS"]
    kind = {doc_id: 1 if at < 20_000 else 2 for at, doc_id in enumerate(order)} | {30_000 + i: 0 for i in range(200)}
    docs = spark.createDataFrame([(doc_id, texts[at]) for doc_id, at in kind.items()], "doc_id long, text string")
    labels = spark.createDataFrame([(doc_id, int(at == 0)) for doc_id, at in kind.items()], "doc_id long, quality int")
    out = preference.preference_scores(docs, labels).collect()
    assert all(row["predicted"] == int(kind[row["doc_id"]] == 0) for row in out)
