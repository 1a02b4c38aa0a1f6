"""Templates, clustering and spelling groups against plain loops, SQL and odd rows."""

import hashlib
import itertools
import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pandas as pd
import pytest

from quarryline.llm import queries as Q
from quarryline.llm.chat_format import CONTROLS, conversation_digests, escape, format_conversations, read_turns, unescape
from quarryline.llm.chat_template import TemplateError, compile_template
from quarryline.llm.lloyd import cluster_vectors
from quarryline.llm.spelling import group_spellings

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["op11_chat_formatting", "op12_centroid_clustering", "op13_spelling_variants"])
def test_same_as_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want = con.execute(Q.oracle_sql()[name]).df()
    got = Q.queries()[name](spark, SF).toPandas()
    assert sorted(got.columns) == sorted(want.columns)
    columns, written = sorted(want.columns), lambda v: "null" if pd.isna(v) else str(int(v)) if isinstance(v, (int, float, np.number)) else v
    rows = lambda frame: sorted(tuple(map(written, r)) for r in frame[columns].itertuples(index=False))
    assert rows(got) == rows(want)


# ---------------------------------------------------------------- templates


def rendered(template, messages, **constants):
    made = compile_template(template, constants, escape)
    parts = [p for i, m in enumerate(messages) for p in made.parts(m, i, len(messages))]
    return "".join(t for t, _ in parts), "".join(t for t, marked in parts if marked)


TALK = [{"role": "user", "text": " a\n"}, {"role": "assistant", "text": "b"}, {"role": "user", "text": "c"}]


@pytest.mark.parametrize("template, whole, marked", [
    ("{{ bos }}{% for m in messages %}{{ m.role[0] }}:{{ m.text | trim }}{% if not loop.last %}, {% endif %}{% endfor %}!", "<s>u:a, a:b, u:c!", ""),
    ("{% for m in messages %}{% generation %}{% if m.role == 'assistant' %}{{ m['text'] }}{% else %}{% endif %}{% endgeneration %}{% endfor %}", "b", "b"),
    ("{% set sep = '-' * 2 %}{% for m in messages %}{{ loop.index ~ sep }}{% set sep = '+' %}{{ sep }}{% endfor %}", "1--+2--+3--+", ""),
    ("{% for m in messages -%}  x {#- note -#} {%- endfor %}", "xxx", ""),
    ("{% for m in messages %}{{ 'U' if m.role == 'user' else 'A' }}{% for k in [1, 2] %}{{ k + loop.index0 }}{% endfor %}{% endfor %}", "U13A13U13", ""),
    ("{% for m in messages %}{{ m.name is defined }}{{ m.name | default('?') }}{{ none is none }}{{ 'a' not in 'bc' and 3 >= 2 }}{{ -1 + 7 % 4 }}|{% endfor %}", "False?TrueTrue2|" * 3, ""),
    ("{% for m in messages %}{% if loop.first %}1{% elif loop.last %}3{% else %}2{% endif %}{% endfor %}", "123", ""),
])
def test_templates(template, whole, marked):
    assert rendered(template, TALK, bos="<s>") == (whole, marked)


@pytest.mark.parametrize("template", [
    "{% for m in messages %}{% endif %}", "{% for m in messages %}", "{{ messages[0].text }}{% for m in messages %}{% endfor %}", "no loop", "{% for m in messages %}{{ m.text.strip() }}{% endfor %}",
    "{% for m in messages %}{{ m.text | attr }}{% endfor %}", "{% include 'x' %}{% for m in messages %}{% endfor %}", "{% for m in messages %}{{ 9 * 9 ** 9 }}{% endfor %}", "{{ 'x' * 99999999999 }}{% for m in messages %}{% endfor %}",
])
def test_refused_templates(template):
    with pytest.raises(TemplateError):
        compile_template(template)


def test_no_attribute_of_python_is_reached():
    assert rendered("{% for m in messages %}{{ m.__class__ }}{{ m.text.__class__ }}{{ m['keys'] }}{% endfor %}", TALK) == ("", "")


def test_constants_are_folded():
    tree = compile_template("{{ a }}-{{ 1 + 2 }}{% if b %}x{% else %}y{% endif %}{% for m in messages %}{{ a ~ 'z' }}{{ m.text }}{% endfor %}", {"a": "A", "b": False}).tree
    assert [p.kind for p in tree.parts] == ["text", "for"] and tree.parts[0].value == "A-3y"
    assert [p.kind for p in tree.parts[1].parts[1].parts] == ["text", "show"] and tree.parts[1].parts[1].parts[0].value == "Az"
    shadow = compile_template("{% set a = 'own' %}{% for m in messages %}{{ a }}{% endfor %}", {"a": "A"})
    assert "".join(t for t, _ in shadow.parts(TALK[0], 0, 1)) == "own"


def test_escaping_is_reversible():
    rng = random.Random(5)
    alphabet = [*CONTROLS, "\\", "<", "[", "]", ">", "/", "s", "INST", "a", "\n", " ", "é"]
    for _ in range(3000):
        text = "".join(rng.choices(alphabet, k=rng.randrange(9)))
        assert unescape(escape(text)) == text and not any(c in escape(text) for c in CONTROLS)


def digest_of(turns):
    answers = [t for r, t in turns if r == "assistant"]
    return len(turns), hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest(), sum(map(len, answers)), hashlib.sha256("".join(answers).encode()).hexdigest()


@pytest.mark.parametrize("block", [4096, 3])
def test_conversations_come_back(spark, block, monkeypatch):
    rng, given = random.Random(7), []
    words = [*CONTROLS, " ", "\\", "x", "é\n", "[\\INST]", "<"]
    for conv in [None, *range(12)]:
        for turn in range(rng.randrange(1, 30)):
            given.append((conv, rng.choice([turn, turn, None, 2]), rng.choice(["user", "assistant", "system", "tool", "[ROLE]x", None]), rng.choice([None, "", "".join(rng.choices(words, k=5))])))
    given += [(3, 1, "user", "same")] * 2 + [(4, 9, "assistant", "long </s> " * 300000)]
    frame = spark.createDataFrame([(*r, "odd") for r in given], "conv_id long, turn long, role string, text string, formatted string").repartition(5)
    got = {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in conversation_digests(format_conversations(frame, block=block)).collect()}
    order = lambda r: (r[1] is not None, r[1] or 0, (r[2] or "").encode(), (r[3] or "").encode())
    want = {}
    for conv in {r[0] for r in given}:
        want[conv] = digest_of([(r[2] or "", r[3] or "") for r in sorted((r for r in given if r[0] == conv), key=order)])
    assert got == want


def test_pieces_hold_whole_turns_and_masks(spark):
    rows = [(1, t, "user" if t % 2 == 0 else "assistant", f"{t} </s> " * 20000) for t in range(40)]
    frame = spark.createDataFrame(rows, "conv_id int, turn int, role string, text string")
    pieces = sorted(format_conversations(frame, block=7).collect(), key=lambda r: (r.block, r.piece))
    assert len(pieces) > 6 and not any(r.whole for r in pieces) and sum(r.n_turns for r in pieces) == 40
    assert [t for r in pieces for t in read_turns(r.formatted)] == [r[2:] for r in rows]
    assert [unescape(r.formatted[a:b]) for r in pieces for a, b in zip(r.starts, r.ends)] == [r[3] for r in rows if r[2] == "assistant"]
    assert pieces[0].formatted.startswith("<s>[INST] ") and "<s>" not in pieces[1].formatted


def test_empty_conversations(spark):
    frame = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert conversation_digests(format_conversations(frame)).collect() == []


# ---------------------------------------------------------------- clustering


def lloyd(rows, k, rounds):
    kept = [(i, [min(max(int(np.floor(64 * float(x))), -(1 << 27)), 1 << 27) for x in v]) for i, v in rows]
    drawn = sorted(kept, key=lambda r: (hashlib.sha256(f"1:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))
    points = [list(v) for _, v in drawn[:k]]
    place = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, c)), j) for j, c in enumerate(points))
    for _ in range(rounds):
        groups = {}
        for _, v in kept:
            groups.setdefault(place(v)[1], []).append(v)
        for j, g in groups.items():
            points[j] = [sum(x) // len(g) for x in zip(*g)]
    return Counter((i, place(v)[1], place(v)[0], hashlib.sha256(",".join(map(str, points[place(v)[1]])).encode()).hexdigest()) for i, v in kept)


@pytest.mark.parametrize("n, k", [(60, 5), (3, 5), (0, 5)])
def test_clusters_like_plain_loops(spark, n, k):
    rng = random.Random(n)
    good = [(rng.choice([i, i, None, 1]), [rng.uniform(-2, 2) for _ in range(4)]) for i in range(n)]
    good += good[:3] + ([(90, [1e30, -1e30, 0.0, 0.0]), (91, [0.0] * 4), (92, [0.0] * 4)] if n > 3 else [])
    bad = [(1, None), (2, [1.0] * 3), (3, [1.0, None, 1.0, 1.0]), (4, [1.0, float("nan"), 1.0, 1.0]), (5, [1.0, float("inf"), 1.0, 1.0]), (6, [1.0] * 5), (7, [])]
    frame = spark.createDataFrame([(i, v, 3) for i, v in good + bad], "vec_id long, embedding array<double>, cluster int").repartition(4)
    got = cluster_vectors(frame, k=k, rounds=3, dimension=4).collect()
    assert Counter((r.vec_id, r.cluster, r.distance, r.centroid_sha256) for r in got) == lloyd(good, k, 3)
    for c in {r.cluster for r in got}:
        assert {r.cluster_inertia for r in got if r.cluster == c} == {sum(r.distance for r in got if r.cluster == c)}
    assert {r.inertia for r in got} == ({sum(r.distance for r in got)} if got else set())


# ---------------------------------------------------------------- spelling


def one_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def spelling(rows):
    counts = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            counts[run[: h % len(run)] + run[h % len(run) + 1 :] if h % 31 == 0 else run] += 1
    counts = {w: n for w, n in counts.items() if len(w) >= 7 and n >= 2}
    near = {w: [] for w in counts}
    for a, b in itertools.combinations(counts, 2):
        if abs(len(a) - len(b)) < 2 and one_edit(a, b):
            near[a].append(b)
            near[b].append(a)
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda o: (-counts[o], o), default=None)
        form[w] = best if best and counts[best] >= 10 * counts[w] else None
    out = set()
    for w in counts:
        root = w
        while form[root]:
            root = form[root]
        out.add((w, counts[w], len(near[w]), form[w], counts[form[w]] if form[w] else None, root))
    return out


def test_spellings_like_plain_loops(spark):
    rng = random.Random(3)
    letters = "abcÉé×ÿß"
    base = ["".join(rng.choices(letters, k=rng.randrange(7, 11))) for _ in range(12)]
    rows = []
    for doc in range(150):
        made = []
        for _ in range(60):
            w = base[min(int(rng.expovariate(0.6)), 11)]
            for _ in range(rng.choice([0, 0, 0, 0, 0, 1, 2])):
                at = rng.randrange(len(w))
                w = rng.choice([w[:at] + w[at + 1 :], w[:at] + rng.choice(letters) + w[at + rng.choice([0, 1]) :], w[:at] + w[at + 1 : at + 2] + w[at : at + 1] + w[at + 2 :]])
            made.append(rng.choice([w, w.upper() if w.isascii() else w, w.title() if w.isascii() else w]))
        rows.append((doc if doc % 9 else None, rng.choice([" ", "1", "\n"]).join(made)))
    rows += [(700, None), (701, ""), (702, "q" * 200000 + " " + "q" * 200000), (702, "q" * 200001 + " " + "q" * 200001), rows[5], rows[5]]
    frame = spark.createDataFrame([(*r, "w", 1) for r in rows], "doc_id long, text string, word string, n int").repartition(4)
    got = {tuple(r) for r in group_spellings(frame).select("word", "n", "n_near", "form", "form_n", "root").collect()}
    want = spelling(rows)
    assert got == want and any(r[3] for r in want) and any(r[5] not in (r[0], r[3]) for r in want)


def test_no_spellings_of_an_empty_table(spark):
    assert group_spellings(spark.createDataFrame([], "doc_id long, text string")).collect() == []


# ---------------------------------------------------------------- faults that were mended


def test_near_dedup_takes_columns_without_an_order(spark):
    import corpus_pipeline

    rows = [(k, "one two three four five six seven", "en", "s", 33, {"a": v}) for k, v in ((1, 2), (1, 1), (2, 1))]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, extra map<string,int>")
    kept = corpus_pipeline.near_dedup(spark, docs, SF).collect()
    assert [(r.doc_id, r.extra) for r in kept] == [(1, {"a": 1})] and kept[0].__fields__ == docs.columns


def test_only_letters_make_a_language(spark):
    from quarryline.llm.langid_gru import has_letter

    assert not any(map(has_letter, ["½ ² 3", "①Ⅷ", "", "12_3!?", "🙂"])) and all(map(has_letter, ["½ a", "ª", "日", "ß"]))


def test_classes_have_numbers_of_their_own(spark):
    from quarryline.llm.dart_minhash import near_duplicates

    texts = ["a b c d e f g h", "p q r s t u v w"]
    got = near_duplicates(spark.createDataFrame([(1, t) for t in texts], "doc_id long, text string")).collect()
    assert [r.class_id for r in got] == [1, 1] and len({r.class_number for r in got}) == 2
