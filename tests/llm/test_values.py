"""Values on nulls, ties, repeated ids and very long texts, and plain loops beside the models and fingerprints."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarryline.llm import queries as Q
from quarryline.llm.boosting import AdditiveTables, BoostedTrees, Isotonic, sigmoid
from quarryline.llm.langid_gru import ByteGru, document_probabilities, stream_windows
from quarryline.llm.packing import TextTokenizer, pack_documents, tokenizer
from quarryline.llm.simhash import fingerprint_documents
from quarryline.llm.suffix_index import CHUNK_BYTES, remove_repeats
from quarryline.llm.toxicity import fit_toxicity, is_hidden, unhidden
from quarryline.llm.unigram import encode_documents
from quarryline.llm.url_filter import judge_urls
from quarryline.llm.weak_rules import judge_quality

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def table(spark, rows):
    return spark.createDataFrame([(k, t, "en", "s", len(t or "")) for k, t in rows], COLUMNS)


def removed(rows):
    """What op7 removes, by brute force; rows without an id come first, in any order of equal windows."""
    seen, out = set(), []
    for _, text in rows:
        raw = (text or "").encode()
        hit = bytearray(len(raw))
        for p in range(len(raw) - 99):
            if raw[p : p + 100] in seen:
                hit[p : p + 100] = b"\1" * 100
            seen.add(raw[p : p + 100])
        out.append((len(raw), sum(hit), len(re.findall(b"\1+", bytes(hit))), hashlib.sha256(bytes(b for b, h in zip(raw, hit) if not h)).hexdigest()))
    return out


# ---------------------------------------------------------------- packing


def test_ids_equal_the_library(spark):
    path = Q.tokenizer_file("byte_bpe_50k.json")
    made = TextTokenizer(path)
    assert made.fast is not None and tokenizer(path) is tokenizer(path)
    rng = random.Random(2)
    latin = [chr(c) for c in range(256)]
    texts = ["", "a<|endoftext|>b", "日本語 text", "x y", " ", " " * 5000, "ab" * 50_000, "don't I'LL we've", "é", " \u0085 \t\r\n", "ж" * 100, "word " * 70_000 + "日"]
    texts += ["".join(rng.choices(latin, k=rng.randint(0, 60))) for _ in range(500)] + ["".join(rng.choices("ab 1'\n\t.\x85\xa0sS²ª", k=30)) for _ in range(500)]
    for text in texts:
        assert made.encode(text).tolist() == made.library.encode(text, add_special_tokens=False).ids
    assert made.encode(None).tolist() == [] and len(made.encode("\n \n" * 300_000)) > 0


def test_packing_odd_rows(spark):
    rows = [(1, None), (2, ""), (2, "a b"), (2, "a b"), (None, "a b"), (3, "word " * 9000)]
    got = pack_documents(table(spark, rows), Q.tokenizer_file("byte_bpe_50k.json")).collect()
    assert Counter((str(r.doc_id), r.length) for r in got if r.doc_id != 3) == Counter({("1", 1): 1, ("2", 1): 1, ("2", 3): 2, ("None", 3): 1})
    long = sorted((r.piece, r.start, r.length) for r in got if r.doc_id == 3)
    total = sum(x[2] for x in long)
    assert [x[2] for x in long[1:]] == [2048] * (len(long) - 1) and long[0][2] == total % 2048 and [x[1] for x in long] == [0, *range(long[0][2], total, 2048)]


# ---------------------------------------------------------------- models against plain loops


def test_trees_tables_and_steps_against_loops():
    rng = np.random.default_rng(4)
    x = rng.normal(size=(400, 5))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0.3)).astype(float)
    trees = BoostedTrees.fit(x, y, trees=30)

    def by_loop(row):
        q = [int(np.searchsorted(e, v, side="right")) for e, v in zip(trees.edges, row)]
        out = trees.prior
        for feature, limit, leaves in trees.trees:
            node = 0
            while node < len(feature):
                node = 2 * node + 1 + (q[feature[node]] > limit[node])
            out += leaves[node - len(feature)]
        return out

    assert trees.margin(x) == pytest.approx([by_loop(r) for r in x])
    assert np.mean((trees.margin(x) > 0) == y) > 0.95
    model = AdditiveTables.fit(x, y, rounds=30)

    def added(row):
        out = model.prior + sum(t[int(np.searchsorted(e, v, side="right"))] for t, e, v in zip(model.single, model.edges, row))
        for i, j, t in model.pairs:
            out += t[int(np.searchsorted(model.coarse[i], row[i], side="right")), int(np.searchsorted(model.coarse[j], row[j], side="right"))]
        return out

    assert model.margin(x) == pytest.approx([added(r) for r in x])
    score, ones = rng.normal(size=200), (rng.random(200) < 0.4).astype(float)
    steps = Isotonic.fit(score, ones)
    assert (np.diff(steps.apply(np.sort(score))) >= 0).all()
    order = np.argsort(score)
    best = [max(min(ones[order][a : b + 1].mean() for b in range(k, 200)) for a in range(k + 1)) for k in range(0, 200, 20)]
    assert steps.value.min() >= 0 and steps.value.max() <= 1 and np.corrcoef(best, steps.apply(score[order][::20]))[0, 1] > 0.9


def test_toxicity_parts_and_hidden_words(spark):
    assert [is_hidden(w, {"badword": 2.0}) for w in ("1d10t!", "@diot", "id*ot", "b4dw0rd", "i.d.i.o.t", "idiot", "5kg", "x*y")] == ["idiot", None, "id*ot", "badword", "idiot", None, None, None]
    assert unhidden("$tup1d,") == "stupid"
    docs = table(spark, [(k, "you are a stupid idiot" if k % 3 == 0 else "a calm and friendly text") for k in range(400)])
    labels = spark.createDataFrame([(k, int(k % 3 == 0)) for k in range(400)], "doc_id long, toxic int")
    model = fit_toxicity(docs, labels, F.lit(True))
    low, high = model.score([None, "you are a stupid idiot"])
    assert 0 <= low < 0.2 and 0.8 < high <= 1
    only = fit_toxicity(docs, labels.filter("toxic = 0"), F.lit(True)).score(["x", ""])
    assert ((0 <= only) & (only < 0.1)).all()


# ---------------------------------------------------------------- language


def test_stream_of_windows():
    raw = bytes(range(1, 250)) * 3
    parts = stream_windows(raw)
    assert b"".join(p[a:b] for p, a, b in parts) == raw and stream_windows(b"") == []
    model = ByteGru.new(["a", "b"], hidden=4)
    texts = ["hello wörld " * 60, "x", None, "12 ...", "日本" * 500, ""]
    found, score = document_probabilities(model, texts)
    assert [f == "und" for f in found] == [False, False, True, True, False, True] and list(score[[2, 3, 5]]) == [0, 0, 0]
    for k in (0, 1, 4):  # a plain loop over each window alone
        total, n = np.zeros(2), 0
        for part, a, b in stream_windows(texts[k].encode()):
            x = np.maximum(np.frombuffer(part, np.uint8), 1).astype(np.int64)[None, :]
            total, n = total + model.positions(x)[a:b, 0].sum(axis=0), n + b - a
        assert score[k] == pytest.approx((total / n).max(), rel=1e-4)
        assert found[k] == "ab"[int(total.argmax())]
    # a word's labels depend on what stands around it
    x = [np.frombuffer(t, np.uint8).astype(np.int64)[None, :] for t in (b"aaaa word zz", b"zzzz word aa")]
    assert not np.allclose(model.positions(x[0])[5:9], model.positions(x[1])[5:9], atol=1e-6)


# ---------------------------------------------------------------- rules


def test_base_counts_brute_force(spark):
    rng = random.Random(3)
    texts = [None, "", " \t\n", "a", "a\n\na\n a", "#x $y z|z\nb & b\n" * 3, "one two three four five six one two three four five six"]
    texts += ["".join(rng.choices("ab #\n\t\x0b%é", k=rng.randint(0, 300))) for _ in range(60)] + ["word " * 300_000]
    rows = [(k // 2, t) for k, t in enumerate(texts)]  # ids repeat
    want = []
    for doc_id, t in rows:
        t = t or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        lines, seen, dup = t.split("\n"), set(), 0
        for line in lines:
            if re.search(r"[^\x20\x09-\x0D]", line):
                dup += line in seen
                seen.add(line)
        count = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
        covered = {j for i in range(len(words) - 4) if count[tuple(words[i : i + 5])] > 1 for j in range(i, i + 5)}
        n = len(words)
        want.append((doc_id, n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", t)), dup, len(covered), n < 10 or 100 * len(covered) > 20 * n))
    got = [(r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in judge_quality(table(spark, rows)).collect()]
    assert sorted(map(str, got)) == sorted(map(str, want))


# ---------------------------------------------------------------- passages


def test_repeats_in_long_texts_and_missing_ids(spark):
    rng = random.Random(7)
    long = "".join(rng.choices("abcdefgh ", k=CHUNK_BYTES + 200_000))
    rows = [(1, long), (2, long[CHUNK_BYTES - 300 : CHUNK_BYTES + 300] + "tail"), (3, None), (3, "short"), (4, "x" * 250), (4, "x" * 250)]
    got = sorted((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in remove_repeats(table(spark, rows)).collect())
    assert got == sorted((k, *w) for (k, _), w in zip(rows, removed(rows)))
    passage = "".join(rng.choices("abcdefgh ", k=150))
    lost = [(None, passage + str(k) * 50) for k in range(40)] + [(0, passage)]
    got = remove_repeats(table(spark, lost)).collect()
    assert sum(r.n_removed == 0 for r in got) == 1 and sum(r.n_removed > 0 for r in got) == 40
    assert {r.n_removed for r in got if r.doc_id == 0} == {150}  # rows without an id come before all others


def test_one_passage_in_many_texts(spark):
    rng = random.Random(9)
    passage = "".join(rng.choices("abcdefgh ", k=300))
    rows = [(k, "".join(rng.choices("abcdefgh ", k=150)) + passage + "".join(rng.choices("abcdefgh ", k=150))) for k in range(3000)]
    got = sorted((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in remove_repeats(table(spark, rows)).collect())
    assert got == [(k, *w) for (k, _), w in zip(rows, removed(rows))] and got[1][2] >= 300


# ---------------------------------------------------------------- fingerprints



def test_fingerprints_of_odd_rows(spark):
    rows = [(3, "b c"), (1, None), (1, ""), (2, "a b c d e f g h"), (3, "b c"), (None, "x y z w"), (9, "é" * 10)]
    got = fingerprint_documents(table(spark, rows), search_every=1).collect()
    ordered = sorted(((k, t or "") for k, t in rows), key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    want = Counter()
    for i, (k, t) in enumerate(ordered):
        after = ordered[(i + 1) % len(ordered)][1]
        n = len(t)
        want[str(k), n, hashlib.sha256((t[: n - n // 4] + after[: n // 4]).encode()).hexdigest()] += 1
    assert Counter((str(r.doc_id), r.n_chars, r.edited_sha256) for r in got) == want
    same = {r.fingerprint for r in got if r.n_chars == 3}
    assert len(same) == 1 and all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in got)
    for r in got:  # the likeness is that of the two fingerprints
        assert r.near_edited == 1 - (int(r.fingerprint, 16) ^ int(r.edited_fingerprint, 16)).bit_count() / 64
    again = {r.fingerprint for r in fingerprint_documents(table(spark, [(1, "b c")]), search_every=1).collect()}
    assert again == same and fingerprint_documents(table(spark, [(5, "one")])).first().near_next == 1.0


# ---------------------------------------------------------------- urls and pieces


def test_urls_without_host(spark):
    rules = spark.createDataFrame(Q.URL_RULES, "rule string, verdict string")
    pages = spark.createDataFrame([(k, None if k % 2 else "no scheme") for k in range(2000)] + [(None, "http:///en/"), (7, "http://example.com/en/")], "page_id long, url string")
    got = judge_urls(pages, rules)
    assert got.count() == 2002 and got.filter("verdict = 'block'").count() == 1
    assert got.filter("page_id is null").first().path == "/en/"


def test_pieces_of_odd_texts(spark):
    rows = [(1, None), (2, ""), (3, "🎉 ünïcode\n\ttabs  and   spaces "), (3, "🎉"), (None, "plain"), (4, "x" * 100_000)]
    got = encode_documents(table(spark, rows), Q.tokenizer_file("piece_bpe_32k.model")).collect()
    assert len(got) == len(rows) and all(r.round_trip for r in got)


# ---------------------------------------------------------------- the pipeline


def test_stages_on_odd_rows(spark):
    import corpus_pipeline

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    odd = docs.unionByName(table(spark, [(None, None), (None, None), (5, ""), (5, "same id, other text"), (10**9, "word " * 50_000)]).select(docs.columns))
    kept, rows = odd.withColumn("extra", F.lit("x")).withColumn("digest", F.lit(1)), odd.count()
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, kept, sf)
        n = out.count()
        assert 0 < n
        if name == "packing":
            break
        assert out.columns == kept.columns and n <= rows
        assert stage(spark, kept.filter("false"), sf).count() == 0
        kept, rows = spark.createDataFrame(out.collect(), out.schema), n
    assert out.select("doc_id").distinct().count() >= kept.select("doc_id").distinct().count() - 1


def test_pipeline_is_its_stages(spark):
    import corpus_pipeline

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf)
    assert sorted(map(str, docs.select("doc_id", "piece", "length", "ids_crc32").collect())) == sorted(map(str, corpus_pipeline.run(spark, sf).select("doc_id", "piece", "length", "ids_crc32").collect()))


def test_model_probabilities_are_bounded():
    assert sigmoid(np.array([-1e9, 0, 1e9])) == pytest.approx([0, 0.5, 1], abs=1e-9)
