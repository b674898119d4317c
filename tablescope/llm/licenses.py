"""License scans: ordered signature rules over the words of every text, in Spark's own functions only.

A text becomes its lower-case words (A-Z only). Texts in which no gate stem stands are done. The
words of the others are looked at in stretches of STRETCH words with LONGEST words on either side, so
that the work in one stretch is bounded however long the text is. In a stretch a rule is
tried only where its keyword stands. A detection is suppressed where another one covers it: holds its whole
interval and has a better priority, or the same and is longer, or the same interval and an earlier
rule. Base phrases are counted at all their places, suppressed or not.

Null and empty texts have no words: counts 0, no places, empty labels, score 0. Rows are not looked
at together: repeated rows, null ids and ids that rows share give one row each. No row is shuffled.
"""

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablescope.llm.license_rules import GATES, LONGEST, Rule, pattern, rules

STRETCH = 512
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def plain_words(text: Column) -> Column:
    """Lower-case words joined by single blanks, one blank at either end."""
    lower = F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)
    return F.regexp_replace(F.concat(F.lit(" "), lower, F.lit(" ")), r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", " ")


_RULES = ("array<struct<keyword string, rules array<struct<order int, pattern string, label string, priority int, "
          "confidence double, base boolean>>>>")


def _rule_table(found: list[Rule]) -> Column:
    """The rules as a constant, which the optimiser folds: an array of (keyword, array of rules), in order."""
    groups: dict[str, list] = {}
    for order, r in enumerate(found):
        groups.setdefault(r.keyword, []).append({"order": order, "pattern": pattern(r.words), "label": r.label, "priority": r.priority,
                                                 "confidence": r.confidence, "base": r.base})
    return F.from_json(F.lit(json.dumps([{"keyword": k, "rules": v} for k, v in groups.items()])), _RULES)


def _stretches(words: Column) -> Column:
    """(first own word, end of own words, numbered words with their surroundings) of each stretch."""
    def one(at):
        low = F.greatest(at - LONGEST, F.lit(0))
        near = F.slice(words, low + 1, at - low + STRETCH + LONGEST)
        numbered = F.transform(near, lambda w, i: F.concat(F.lit(" "), w, F.lit("#"), (i + low).cast("string"), F.lit(" ")))
        return F.struct(at.alias("low"), (at + STRETCH).alias("high"), F.array_join(numbered, "").alias("words"))
    return F.transform(F.sequence(F.lit(0), F.greatest(F.size(words) - 1, F.lit(0)), F.lit(STRETCH)), one)


def _hits(words: Column, table: Column) -> Column:
    """All matches of all rules whose keyword stands in the numbered words."""
    def places(rule):
        return F.transform(F.regexp_extract_all(words, rule["pattern"], F.lit(0)), lambda m: F.struct(
            F.regexp_extract(m, "#([0-9]+)", 1).cast("int").alias("start"),
            F.regexp_extract(m, "#([0-9]+) $", 1).cast("int").alias("end"),
            rule["order"].alias("order"), rule["label"].alias("label"), rule["priority"].alias("priority"),
            rule["confidence"].alias("confidence"), rule["base"].alias("base")))
    near = F.filter(table, lambda g: F.contains(words, g["keyword"]))
    return F.flatten(F.transform(near, lambda g: F.flatten(F.transform(g["rules"], places))))


def _covers(a: Column, b: Column) -> Column:
    longer = a["end"] - a["start"] > b["end"] - b["start"]
    better = (a["priority"] < b["priority"]) | ((a["priority"] == b["priority"]) & (longer | (a["order"] < b["order"])))
    return (a["start"] <= b["start"]) & (a["end"] >= b["end"]) & better


def detections(text: Column, found: list[Rule] | None = None, gates: list[str] | None = None) -> Column:
    """Array of (start, end, order, label, priority, confidence, base, kept), in order of stretches."""
    table = _rule_table(rules() if found is None else found)
    gate = None
    for stem in GATES if gates is None else gates:
        here = F.contains(text, F.lit(stem))
        gate = here if gate is None else gate | here
    words = F.split(F.trim(text), " ")

    def own(stretch):
        return F.transform(F.filter(F.array(_hits(stretch["words"], table)), lambda h: F.size(h) > 0), lambda all_hits: F.transform(
            F.filter(all_hits, lambda h: (h["start"] >= stretch["low"]) & (h["start"] < stretch["high"])),
            lambda b: F.struct(b["start"].alias("start"), b["end"].alias("end"), b["order"].alias("order"), b["label"].alias("label"),
                               b["confidence"].alias("confidence"), b["base"].alias("base"),
                               (~F.exists(all_hits, lambda a: _covers(a, b))).alias("kept"))))
    return F.when(gate, F.flatten(F.flatten(F.transform(_stretches(words), own))))


def scan(docs: DataFrame, text_col: str = "text", found: list[Rule] | None = None,
         gates: list[str] | None = None, out: str = "licenses") -> DataFrame:
    """The rows with a struct column `out`: n_words, n_base, first_word, last_word, base_labels, labels, score, detections.

    `labels` holds the base labels and those of kept detections; `score` is the confidence of the
    best kept or base detection. A column named `out` is replaced; all others stay. With rules of your own,
    give gates as well: stems of which one stands wherever a rule matches.
    """
    inner = "_" + "_".join(sorted(docs.columns, key=len)[-1:])  # longer than every column, so no column is hidden
    words, hits = inner + "w", inner + "h"
    spaced = docs.withColumn(words, plain_words(F.col(f"`{text_col}`")))
    spaced = spaced.withColumn(hits, F.coalesce(detections(F.col(f"`{words}`"), found, gates), F.array()))
    text, all_hits = F.col(f"`{words}`"), F.col(f"`{hits}`")
    # every word has one blank before it, and the text one more at its end
    n_words = F.greatest(F.octet_length(text) - F.octet_length(F.replace(text, F.lit(" "), F.lit(""))) - 1, F.lit(0)).cast("long")
    base = F.filter(all_hits, lambda h: h["base"])
    told = F.filter(all_hits, lambda h: h["base"] | h["kept"])
    joined = lambda hs: F.array_join(F.array_sort(F.array_distinct(F.transform(hs, lambda h: h["label"]))), ",")
    places = F.transform(base, lambda h: h["start"].cast("long"))
    return spaced.withColumn(out, F.struct(
        n_words.alias("n_words"), F.size(base).cast("long").alias("n_base"), F.array_min(places).alias("first_word"),
        F.array_max(places).alias("last_word"), joined(base).alias("base_labels"), joined(told).alias("labels"),
        F.coalesce(F.array_max(F.transform(told, lambda h: h["confidence"])), F.lit(0.0)).alias("score"),
        told.alias("detections"))).drop(words, hits)
