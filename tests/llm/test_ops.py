"""Operators against brute force, exact round trips and held-out accuracy, on small tables and odd rows."""

import hashlib
import os
import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest

from quarryline.llm import queries as Q
from quarryline.llm.components import components
from quarryline.llm.dart_minhash import cells, dart_signatures, near_duplicates
from quarryline.llm.langid_gru import ByteGru, identify_languages, padded
from quarryline.llm.packing import pack_documents, plan_packing
from quarryline.llm.quality_gam import score_quality
from quarryline.llm.simhash import fingerprint_documents
from quarryline.llm.suffix_index import SuffixLevels, remove_repeats, without_repeats
from quarryline.llm.toxicity import score_toxicity
from quarryline.llm.unigram import UnigramModel, encode_documents
from quarryline.llm.url_filter import judge_urls
from quarryline.llm.weak_rules import RULES, covered_by_repeats, fit_posteriors, judge_quality, measure, votes

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, _id string, cells string, ranges string"
LABELS = "doc_id long, quality int, toxic int"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def odd(spark):
    """Null and empty texts, ties, repeated rows, a null id, a long word, columns whose names clash."""
    long = "lorem ipsum dolor sit amet " * 400
    texts = [None, "", "   ", "one two", long, long, "x" * 5000, "ünïcödé 日本語 🎉 text with some words in it", "\n\t\n", "the same text", "the same text"]
    rows = [(k, t, None, "s", None if t is None else len(t), "i", "c", "r") for k, t in enumerate(texts)]
    return spark.createDataFrame([*rows, rows[3], (None, "no id here", "en", None, 10, "i", "c", "r")], SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def texts_of(frame):
    return [r["text"] for r in sorted(frame.select("doc_id", "text").collect(), key=lambda r: r["doc_id"])]


def test_odd_and_empty_tables(spark, odd, empty):
    labels = spark.createDataFrame([(1, 1, 0), (3, None, None), (4, 0, 1), (None, 1, 1)], LABELS)
    path, model = Q.tokenizer_file("byte_bpe_50k.json"), Q.tokenizer_file("piece_bpe_32k.model")
    for made in (
        lambda d: score_toxicity(d, labels), lambda d: score_quality(d, labels), lambda d: encode_documents(d, model), judge_quality, remove_repeats, near_duplicates, fingerprint_documents, identify_languages,
    ):
        assert made(odd).count() == odd.count()
        assert made(empty).count() == 0
    assert pack_documents(empty, path).count() == 0
    assert pack_documents(odd, path).count() >= odd.count()
    assert without_repeats(odd).columns == odd.columns
    assert without_repeats(empty).count() == 0


def test_packing(docs):
    rows = pack_documents(docs, Q.tokenizer_file("byte_bpe_50k.json")).collect()
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(Q.tokenizer_file("byte_bpe_50k.json"))
    want = {}
    for doc_id, text in docs.select("doc_id", "text").collect():
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids + [0]
        cuts = [0, *range(len(ids) % 2048 or 2048, len(ids) + 1, 2048)]
        for k, (a, b) in enumerate(zip(cuts, cuts[1:])):
            want[doc_id, k] = (a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes()))
    assert {(r.doc_id, r.piece): (r.start, r.length, r.ids_crc32) for r in rows} == want
    by_sequence = {}
    for r in rows:
        by_sequence.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in by_sequence.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048
    assert len(by_sequence) <= 1.02 * sum(r.length for r in rows) / 2048 + 2


def test_plan_places_every_item_once():
    rng = random.Random(3)
    for _ in range(20):
        histogram = dict(Counter(rng.randint(1, 64) for _ in range(rng.randint(0, 300))))
        runs = plan_packing(histogram, 64, 8)
        placed = Counter()
        for lengths, n in runs:
            assert sum(lengths) <= 64
            for x in lengths:
                placed[x] += n
        assert placed == Counter(histogram)


def test_url_filter_same_as_sql(spark):
    pages = f"{SF}/pages.parquet"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{pages}'")
    want = con.execute(Q.OP4_SQL).fetchall()
    got = [tuple(r) for r in Q.op4_url_filter(spark, SF).collect()]
    assert sorted(map(str, got)) == sorted(map(str, want))


def test_url_filter_odd_rows(spark):
    rules = spark.createDataFrame(Q.URL_RULES, "rule string, verdict string")
    urls = [None, "", "com/", "http://A.COM", "http://a.com?x/", "HTTP://WWW.Example.COM/en/1", "x://example.com/en/", "x://notexample.com/en/", "x://b.net/es/", "x://net/fr/y"]
    got = {r.page_id: (r.host, r.rule, r.verdict) for r in judge_urls(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string"), rules).collect()}
    assert got[0] == got[1] == got[2] == ("", None, "allow")
    assert got[3] == ("a.com", None, "allow") and got[5] == ("www.example.com", "www.example.com/en/", "allow")
    assert got[6][1:] == ("example.com/en/", "block") and got[7][1:] == ("com/", "allow")
    assert got[8][1:] == ("net/es/", "block") and got[9][1:] == ("net/fr/", "block")
    assert judge_urls(spark.createDataFrame([], "page_id long, url string"), rules).count() == 0


def test_repeated_words_brute_force():
    rng = random.Random(5)
    for _ in range(200):
        words = [rng.choice("abc") for _ in range(rng.randint(0, 40))]
        seen = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
        covered = {j for i in range(len(words) - 4) if seen[tuple(words[i : i + 5])] > 1 for j in range(i, i + 5)}
        assert covered_by_repeats(words) == len(covered)


def test_weak_rules_keep_good_documents(spark, docs):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    rows = judge_quality(docs).join(labels, "doc_id").filter("not base_failed").collect()
    assert np.mean([r.kept == bool(r.quality) for r in rows]) > 0.9
    assert fit_posteriors(np.zeros(0, int), np.zeros(0))[0].shape == (0,)


def test_repeats_brute_force(docs):
    seen, want = set(), {}
    for doc_id, text in sorted(map(tuple, docs.select("doc_id", "text").collect())):
        raw = (text or "").encode()
        hit = bytearray(len(raw))
        for p in range(len(raw) - 99):
            if raw[p : p + 100] in seen:
                hit[p : p + 100] = b"\1" * 100
            seen.add(raw[p : p + 100])
        want[doc_id] = (len(raw), sum(hit), len(re.findall(b"\1+", bytes(hit))), hashlib.sha256(bytes(b for b, h in zip(raw, hit) if not h)).hexdigest())
    assert {r.doc_id: tuple(r)[1:] for r in remove_repeats(docs).collect()} == want


def test_near_duplicates_brute_force(docs):
    texts = dict(map(tuple, docs.select("doc_id", "text").collect()))
    sets = {}
    for k, t in texts.items():
        words = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        sets[k] = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4)) if len(words) >= 5 else Counter([tuple(words)] if words else [])
    parent = {k: k for k in texts}

    def root(k):
        while parent[k] != k:
            k = parent[k]
        return k

    keys = sorted(texts)
    for i, a in enumerate(keys):
        for b in keys[i + 1 :]:
            both = sum((sets[a] & sets[b]).values())
            if texts[a] == texts[b] or both and both / sum((sets[a] | sets[b]).values()) >= 0.8:
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    assert {r.doc_id: r.class_id for r in near_duplicates(docs).collect()} == {k: root(k) for k in keys}


def test_dart_estimate():
    rng = random.Random(1)
    words = ["".join(rng.choices("abcdefgh", k=4)) for _ in range(500)]
    other = words[:]
    other[100] = other[300] = "zz"
    cell, owner = cells([" ".join(words), " ".join(other)])
    a, b = set(cell[owner == 0]), set(cell[owner == 1])
    signature = dart_signatures(cell, owner, 2, 4000)
    assert abs((signature[0] == signature[1]).mean() - len(a & b) / len(a | b)) < 0.03


def test_components_of_a_chain(spark):
    links = spark.createDataFrame([(k, k + 1) for k in range(40)] + [(100, 101)], "a long, b long")
    labels = dict(map(tuple, components(links).collect()))
    assert set(labels[k] for k in range(41)) == {0} and labels[101] == 100


def test_fingerprints_brute_force(docs):
    rows = sorted(fingerprint_documents(docs, search_every=10).collect(), key=lambda r: r.doc_id)
    texts = [t or "" for t in texts_of(docs)]
    prints = [int(r.fingerprint, 16) for r in rows]
    by_text = {}
    for i, r in enumerate(rows):
        n = len(texts[i])
        edited = texts[i][: n - n // 4] + texts[(i + 1) % len(texts)][: n // 4]
        assert r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest() and r.n_chars == n
        assert r.near_next == 1 - (prints[i] ^ prints[(i + 1) % len(prints)]).bit_count() / 64
        assert by_text.setdefault(texts[i], r.fingerprint) == r.fingerprint
        if r.doc_id % 10 == 0:
            assert (r.n_within or 0) == sum((prints[i] ^ p).bit_count() <= 3 for p in prints) - 1
    assert np.mean([r.near_edited > r.near_next for r in rows]) > 0.95


def test_pieces_round_trip_and_best_score(docs):
    path = Q.tokenizer_file("piece_bpe_32k.model")
    assert all(r.round_trip for r in encode_documents(docs, path).collect())
    model = UnigramModel(path)
    score = {p: s for p, s in zip(model.text, model.score) if s}
    for word in ["▁hello", "▁thing", "▁ab", "▁zq🎉x"]:
        best = {0: 0.0}
        for j in range(1, len(word) + 1):
            best[j] = max(best[i] + float(score.get(word[i:j], -np.inf if j - i > 1 else model.worst)) for i in range(j))
        ids = np.frombuffer(model._solve([word])[0], "<i4")
        got = sum(float(model.score[i]) for i in ids if i not in set(model.fallback))
        unknown = sum(c not in score for c in word)
        assert got + unknown * float(model.worst) == pytest.approx(best[len(word)], abs=1e-3)


def test_gru_gradients():
    model = ByteGru.new(["a", "b"], hidden=3)
    model.inputs, model.recurrent = [w.astype(float) for w in model.inputs], [w.astype(float) for w in model.recurrent]
    model.out, model.bias = model.out.astype(float), model.bias.astype(float)
    x, _ = padded([b"hello", b"ab"])
    labels = np.array([0, 1])

    def loss():
        p = model.positions(x)
        return -sum(np.log(p[t, i, labels[i]]) for i in range(2) for t in range(x.shape[1]) if x[i, t]) / (x > 0).sum()

    for w, g in zip([*model.inputs, *model.recurrent, model.out, model.bias], model._gradients(x, labels)):
        at = np.unravel_index(np.abs(g).argmax(), g.shape)
        old = w[at]
        w[at] = old + 1e-4
        up = loss()
        w[at] = old - 1e-4
        down = loss()
        w[at] = old
        assert g[at] == pytest.approx((up - down) / 2e-4, rel=1e-3, abs=1e-6)


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    quality = score_quality(docs, labels).filter("held_out").join(labels, "doc_id").collect()
    assert np.mean([r.predicted == r.quality for r in quality]) > 0.95
    toxic = score_toxicity(docs, labels).filter("held_out").join(labels, "doc_id").collect()
    assert np.mean([r.predicted == r.toxic for r in toxic]) > 0.9
    langs = identify_languages(docs).filter("held_out").join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert np.mean([r.lang_pred == r.lang for r in langs]) > 0.95


def test_near_duplicates_of_repeated_and_missing_ids(spark):
    import corpus_pipeline

    rng = random.Random(8)
    a, b, c, d = (" ".join("".join(rng.choices("abcdefgh", k=5)) for _ in range(200)) for _ in range(4))
    rows = [(1, a), (1, b), (2, b + " more"), (3, a + " more"), (None, c), (None, c), (None, c + " more"), (None, d), (4, d + " more"), (5, None), (None, "")]
    frame = spark.createDataFrame([(k, t, "en", "s", len(t or "")) for k, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = sorted((str(r.doc_id), str(r.class_id)) for r in near_duplicates(frame).collect())
    assert got == sorted([("1", "1"), ("1", "1"), ("2", "1"), ("3", "1"), *[("None", "None")] * 3, ("None", "4"), ("4", "4"), ("5", "5"), ("None", "5")])
    kept = Counter(r.text for r in corpus_pipeline.near_dedup(spark, frame, SF).collect())
    one_of_c = min(c, c + " more", key=lambda t: hashlib.md5(t.encode()).hexdigest())
    assert kept == Counter([a, b, one_of_c, d + " more", None])


def test_variety_of_long_texts():
    rng = random.Random(6)
    rule = dict(RULES)["variety"]
    few, many = ([rng.choice(words) for _ in range(12_001)] for words in ([f"w{k}" for k in range(100)], [f"w{k}" for k in range(50_000)]))
    for words, vote in ((few, -1), (many, 1)):
        for n in (5000, 5001, 6000, 12_001):
            assert rule(measure(" ".join(words[:n])), n) == vote
    assert measure("a b a")["same_share"] == pytest.approx(1 / 3) and measure("")["same_share"] == 1.0 and votes(measure("")) >= 0


def test_suffix_levels_go_to_disk():
    rng = random.Random(9)
    index, seen = SuffixLevels(3, most=50), set()
    for _ in range(60):
        windows = ["".join(rng.choices("abcdefgh", k=3)).encode() for _ in range(40)]
        found = index.add(np.array(windows, "S3"))
        for w, f in zip(windows, found):
            assert f == (w in seen)
            seen.add(w)
        assert sum(map(len, index.levels)) <= 50
    assert sum(map(len, index.files)) + sum(map(len, index.levels)) == len(seen) and len(index.files) < 8
    folder = index.folder.name
    index.close()
    assert not os.path.exists(folder)
