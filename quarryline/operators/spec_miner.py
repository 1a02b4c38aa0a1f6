"""Specifications in prose: labels of a table found in one pass, longest spans first, and the first quantity of their kind behind them.

Label tables are relations (key, kind, phrase, exact, not_before, not_after), collected behind a check of their number and sent to the
tasks as one automaton; no expression grows with them. Spans of one text never overlap, so a label within a longer one isn't a label.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import product

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.phrases import PhraseAutomaton, longest_apart
from ..functions.quantities import parse_quantities
from .attributes import with_read

#: A label table of more rows isn't collected.
MOST_LABELS = 100_000
#: Characters before a label and behind it that tell what it is, and those behind it in which its value stands.
BEFORE, AFTER, REACH = 40, 40, 220
LABEL_SCHEMA = "key string, kind string, phrase string, exact boolean, not_before string, not_after string"

#: Specifications, their kind of quantity, their labels (alternatives with bars, part by part; symbols are written exactly), and what rules them out before and behind.
SPECIFICATIONS = [
    ("Control voltage", "voltage", [("|rated", "control voltage|control circuit voltage"), ("coil voltage",)], ["Uc"], "resistance|power|consumption|current|inrush|pickup|drop[- ]?out", None),
    ("Rated insulation voltage", "voltage", [("|rated", "insulation voltage"), ("isolation voltage",)], ["Ui"], None, None),
    ("Rated impulse withstand voltage", "voltage", [("|rated", "impulse voltage|impulse withstand voltage"), ("rated surge voltage",)], ["Uimp"], None, None),
    ("Voltage drop", "voltage", [("|on-state", "voltage drop"), ("residual voltage",)], [], None, None),
    ("Rated voltage", "voltage", [("rated|nominal|operating|operational|supply|input|output|working|mains|auxiliary|load", "voltage", "|range|rating|limit|limits"), ("field power|module supply|sensor supply", "voltage", "|range"), ("min|minimum|max|maximum", "|rated|operating|supply", "voltage"), ("voltage", "range|rating|rated value|nominal value|limit|limits")], ["Ue", "Us", "Ub", "Un", "Ur"],
     "insulation|isolation|impulse|surge|withstand|control|coil|drop|short[- ]?circuit|trip", r"\(type\s+[a-z]|^\s*(?:range\s+)?of\s+test"),
    ("Breaking capacity", "current", [("short-circuit", "current|capacity|breaking|withstand|rating"), ("interrupting|interrupt|breaking", "rating|capacity")], ["Icu", "Ics", "Icw", "Icm", "Icn", "SCCR", "AIC"], None, None),
    ("Leakage current", "current", [("leakage current|off-state current|off-state leakage|residual current",)], [], "rated residual|differential", None),
    ("Current consumption", "current", [("current consumption|current draw|no-load current",), ("input|supply|module|electronics|sensor|quiescent|idle|standby", "current")], [], "leakage|residual|fault|short[- ]?circuit|breaking|interrupt", None),
    ("Rated current", "current", [("rated|nominal|operating|operational|continuous|thermal|load|output|line|full-load", "current", "|rating|range|value"), ("rated operational current",)], [], "leakage|residual|short[- ]?circuit|breaking|consumption", None),
    ("Net weight", "mass", [("|net|gross", "weight")], [], "packag", None),
    ("Operating temperature", "temperature", [("operating|ambient|working|surrounding", "temperature", "|range")], [], "storage|transport", None),
    ("Tightening torque", "torque", [("|tightening", "torque")], [], None, None),
]


def default_labels(spark: SparkSession) -> DataFrame:
    """SPECIFICATIONS as a relation, one row for each phrase."""
    rows = []
    for key, kind, groups, symbols, before, after in SPECIFICATIONS:
        phrases = dict.fromkeys(" ".join(filter(None, parts)) for group in groups for parts in product(*[p.split("|") for p in group]))
        rows += [(key, kind, p, False, before, after) for p in phrases] + [(key, kind, s, True, before, after) for s in symbols]
    return spark.createDataFrame(rows, LABEL_SCHEMA)


def label_spans(texts: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, begin, end, key, kind, label, before, after, not_before, not_after of the labels in (doc_id, text); a text's spans never overlap.

    Places count code points. ``label`` is as written, ``before`` and ``after`` are what stands around it, the latter up to the next label.
    Of phrases that are equal but for case the first by key counts; null texts and phrases have none. Further columns are not read.
    """
    listed = labels.filter("phrase is not null").orderBy("phrase", "key").limit(MOST_LABELS + 1).collect()
    if len(listed) > MOST_LABELS:
        raise ValueError(f"more than {MOST_LABELS} labels")
    rules = [r.asDict() for r in listed]
    sent = texts.sparkSession.sparkContext.broadcast(rules)
    kind = dict(texts.dtypes)["doc_id"]
    columns = {"begin": pa.int32(), "end": pa.int32(), **dict.fromkeys(("key", "kind", "label", "before", "after", "not_before", "not_after"), pa.string())}

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = sent.value
        automaton = PhraseAutomaton([r["phrase"] for r in known])
        for batch in batches:
            id_type, ids, out = batch.schema.field("doc_id").type, [], []
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                if not text:
                    continue
                spans = [s for s in automaton.spans(text) if not known[s[2]]["exact"] or text[s[0] : s[1]] == known[s[2]]["phrase"]]
                chosen = longest_apart(spans)
                for i, (begin, end, number) in enumerate(chosen):
                    rule, stop = known[number], min(end + REACH, chosen[i + 1][0] if i + 1 < len(chosen) else len(text))
                    ids.append(doc_id)
                    out.append((begin, end, rule["key"], rule["kind"], text[begin:end], text[max(0, begin - BEFORE) : begin], text[end:stop], rule["not_before"], rule["not_after"]))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(ids, id_type), *[pa.array(c, t) for c, t in zip(zip(*out), columns.values())]], names=["doc_id", *columns])

    return texts.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, begin int, end int, key string, kind string, label string, before string, after string, not_before string, not_after string")


def mined_specs(texts: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, begin, end, key, label, value: the first quantity of a label's kind between it and the next label, with its kind of current and condition.

    A label that is ruled out by what stands before it or behind it, or that has no such quantity, gives nothing. Texts, and windows in them,
    are read once for each distinct one; texts meet their documents again by their digests.
    """
    digest = F.sha2("text", 256)
    told = texts.filter("text is not null")
    mined = _mined(told.select(digest.alias("doc_id"), "text").distinct(), labels).withColumnRenamed("doc_id", "_digest")
    return told.select("doc_id", digest.alias("_digest")).join(mined, "_digest").select("doc_id", "begin", "end", "key", "label", "value")


def _mined(texts: DataFrame, labels: DataFrame) -> DataFrame:
    spans = label_spans(texts, labels)
    out_before = F.col("not_before").isNotNull() & F.expr("regexp_like(concat(before, ' ', label), concat('(?i)', coalesce(not_before, '')))")
    out_after = F.col("not_after").isNotNull() & F.expr("regexp_like(substring(after, 1, 40), concat('(?i)', coalesce(not_after, '')))")
    digits = F.regexp_replace("after", r"(?i)^\s*(?:[):=|,;.]|-(?!\d)|\b(?:is|are|of|value|range|rated value)\b|\s)+", "")
    open_ = spans.filter(~out_before & ~out_after & F.col("after").rlike(r"\d")).withColumn("window", digits)
    read = with_read(open_, "window", parse_quantities, "quantities", ahead=False)
    first = F.get(F.filter("quantities", lambda q: q["kind"] == F.col("kind")), F.lit(0))
    found = read.select("doc_id", "begin", "end", "key", "label", F.explode(F.array(first)).alias("q")).filter("q is not null")
    flow = F.when(~F.col("q.raw").rlike(r"(?i)V\s*(?:AC|DC)\b"), F.col("q.current_type"))
    return found.select("doc_id", "begin", "end", "key", "label", F.concat_ws(" ", "q.raw", flow, "q.condition").alias("value"))
