"""Operator 9: secret scans over an incremental blob ledger (native).

Every historical version of every path is named by the SHA-256 of its content.
Equal contents are one blob, and a blob is scanned once for each version of each
rule: pairs that the ledger has are not scanned again.  Findings are joined back
to all paths of the blob.  Everything is a DataFrame expression; positions come
from folding the lengths of what lies between matches and of the matches.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import free_name, stage_table


@dataclass(frozen=True)
class Rule:
    """A kind of secret: a Java pattern, what a text must contain to be searched at
    all, and the least length of the match or of its last group."""

    kind: str
    pattern: str
    needs: tuple[str, ...] = ()
    group: int = 0
    least: int = 0
    version: int = 1

    @property
    def name(self) -> str:
        return f"{self.kind}@{self.version}"


#: Fixed values.  The quantifiers of access and hex hold their least lengths: a run
#: that is too short has no part that is long enough.
BASE_RULES = (
    Rule("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", (":", "="), 2, 6),
    Rule("access", r"AKIA[A-Z0-9]{16,}", ("AKIA",)),
    Rule("hex", r"[0-9a-f]{24,}"),
)
#: Between two lines of a key: white space, also escaped, and what quotes or joins strings.
GAP = r"""(?:\\[nr]|[\s"',>]|\+(?=\s))"""
#: A key whose END line is missing: its header lines, runs of base64, a short last line.
HEADERS = GAP + r"*+(?:(?:Proc-Type|DEK-Info|Content-Domain|Comment): ?(?:[^\r\n\\]|\\(?![nr]))*+" + GAP + r"++)*+"
LAST = r"""(?:[\x20\t"',+]*+(?:\\[nr]|[\r\n])""" + GAP + r"""*+[A-Za-z0-9+/=]++(?=[\x20\t]*+(?:[\r\n\\"'-]|\z))|""" + GAP + r"++[A-Za-z0-9+/]++={1,2})?+"
BODY = GAP + r"*+[A-Za-z0-9+/=]{16,}+(?:" + GAP + r"*+[A-Za-z0-9+/=]{16,}+)*+" + LAST
ADDED_RULES = (
    # from BEGIN to the END line of the same label, with no other marker between; else to the end of the body
    Rule("pem", r"-----BEGIN ([A-Z ]*PRIVATE KEY)-----(?:(?:[^-]++|-(?!----))*+-----END \1-----|" + HEADERS + BODY + r"|)", ("PRIVATE KEY",), version=2),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]+", ("eyJ",)),
)
RULES = BASE_RULES + ADDED_RULES
SPAN = "struct<kind:string,rank:int,start:int,end:int>"
NONE = f"array<{SPAN}>"
PLACED = "array<struct<start:int,rank:int,end:int,kind:string>>"


def rule_spans(text: str, rule: Rule, rank: int) -> Column:
    """Leftmost non-overlapping matches of a rule as spans in code points."""
    pattern = F.lit(rule.pattern)
    found = F.regexp_extract_all(text, pattern, F.lit(0))
    values = F.regexp_extract_all(text, pattern, F.lit(rule.group))
    between = F.split(text, rule.pattern, -1)

    def step(a: Column, x: Column) -> Column:
        start = a["at"] + F.char_length(x["0"])
        end = start + F.coalesce(F.char_length(x["1"]), F.lit(0))
        good = x["1"].isNotNull() & (F.char_length(x["2"]) >= rule.least)
        span = F.struct(F.lit(rule.kind).alias("kind"), F.lit(rank).alias("rank"), start.alias("start"), end.alias("end"))
        return F.struct(end.alias("at"), F.when(good, F.concat(a["out"], F.array(span))).otherwise(a["out"]).alias("out"))

    start = F.struct(F.lit(0).alias("at"), F.array().cast(NONE).alias("out"))
    spans = F.aggregate(F.arrays_zip(between, found, values), start, step, lambda a: a["out"])
    there = F.lit(True)
    for i, part in enumerate(rule.needs):
        there = F.contains(F.col(text), F.lit(part)) if i == 0 else there | F.contains(F.col(text), F.lit(part))
    return F.when(there & F.col(text).rlike(rule.pattern), spans).otherwise(F.array().cast(NONE))


def scan(blobs: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """(blob, rules, spans) for blobs with text t and names of rules ``todo``."""
    out = blobs
    for i, rule in enumerate(rules):
        out = out.withColumn(f"s{i}", F.when(F.array_contains("todo", rule.name), rule_spans("t", rule, i)).otherwise(F.array().cast(NONE)))
    spans = F.concat(*(f"s{i}" for i in range(len(rules))))
    by_place = F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["rank"].alias("rank"), s["end"].alias("end"), s["kind"].alias("kind")))
    return out.select("blob", F.col("todo").alias("rules"), F.sort_array(by_place).alias("spans"))


def content_address(versions: DataFrame, text: str) -> DataFrame:
    """The versions with text t (null: empty) and the name ``blob`` of their content."""
    t = F.coalesce(F.col(text), F.lit(""))
    return versions.withColumn("t", t).withColumn("blob", F.unhex(F.sha2(t, 256)))


def update_ledger(versions: DataFrame, text: str, ledger: DataFrame | None = None, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Scan what the ledger lacks; the ledger's rows and the new ones.

    ``ledger`` has (blob, rules, spans), a row for each scan of a blob.  Copies of a
    blob collapse on the map side first, so a blob of which there are many costs
    one text for each task that reads some.
    """
    blobs = content_address(versions, text).select("blob", "t").groupBy("blob").agg(F.first("t").alias("t"))
    names = F.array(*(F.lit(r.name) for r in rules))
    if ledger is None:
        blobs = blobs.withColumn("todo", names)
    else:
        seen = ledger.select("blob", F.explode("rules").alias("r")).groupBy("blob").agg(F.collect_set("r").alias("seen"))
        blobs = blobs.join(seen, "blob", "left").withColumn("todo", F.array_except(names, F.coalesce("seen", F.array().cast("array<string>"))))
        blobs = blobs.filter(F.size("todo") > 0)
    new = stage_table(scan(blobs, rules), "ledger")
    return new if ledger is None else ledger.unionByName(new)


def current_spans(ledger: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(blob, spans) of blobs that have any, by the rules of today's versions."""
    kinds = F.array(*(F.lit(r.kind) for r in rules))
    names = F.array(*(F.lit(r.name) for r in rules))
    valid = F.filter("spans", lambda s: F.arrays_overlap(F.array(F.element_at(names, F.greatest(F.array_position(kinds, s["kind"]).cast("int"), F.lit(1)))), F.col("rules")) & F.array_contains(kinds, s["kind"]))
    kept = ledger.filter(F.size("spans") > 0).select("blob", valid.alias("spans")).filter(F.size("spans") > 0)
    return kept.groupBy("blob").agg(F.sort_array(F.array_distinct(F.flatten(F.collect_list("spans")))).alias("spans"))


def _listing(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def find_secrets(docs: DataFrame, key: str = "doc_id", text: str = "text", ledger: DataFrame | None = None) -> DataFrame:
    """Findings of every row: counts of the base kinds, a digest of the base spans, all spans.

    Null texts are empty; empty texts have no findings; rows with equal texts have
    equal findings, whatever their keys; spans that begin at one place are listed in the
    order of the rules; a text of any length is searched whole, its matches as one array;
    null keys stay null; other columns are left out; an empty table gives no rows.
    """
    found = stage_table(current_spans(update_ledger(docs, text, ledger)), "findings")
    paths = content_address(docs.select(F.col(key).alias("k"), F.col(text).alias("text")), "text").select("k", "blob")
    out = stage_table(paths, "paths").join(found, "blob", "left").withColumn("spans", F.coalesce("spans", F.array().cast(PLACED)))
    base = [r.kind for r in BASE_RULES]
    counts = [F.size(F.filter("spans", _of_kind(k))).cast("long").alias(f"n_{k}") for k in base]
    listed = _listing(F.filter("spans", lambda s: s["kind"].isin(base)))
    return out.select(F.col("k").alias(key), *counts, F.sha2(listed, 256).alias("base_sha256"), _listing(F.col("spans")).alias("spans"))


def _of_kind(kind: str):
    return lambda s: s["kind"] == kind


def redact(docs: DataFrame, text: str = "text", mask: str = "[SECRET]") -> DataFrame:
    """The rows with every span masked; spans that overlap are masked together.

    Null texts stay null; of spans that begin at one place the longest counts; repeated
    rows are masked alike; columns of any name go through; an empty table gives no rows.
    """
    columns = docs.columns
    blob, spans, name = (free_name(docs, c) for c in ("blob", "spans", "name"))
    found = stage_table(current_spans(update_ledger(docs, text)), "findings").select(F.col("blob").alias(blob), F.col("spans").alias(spans))
    named = docs.withColumn(name, F.unhex(F.sha2(F.coalesce(F.col(text), F.lit("")), 256)))

    def step(a: Column, s: Column) -> Column:
        apart = F.when(s["start"] >= a["at"], F.concat(F.substring(F.col(text), a["at"] + 1, s["start"] - a["at"]), F.lit(mask))).otherwise(F.lit(""))
        return F.struct(F.greatest(a["at"], s["end"]).alias("at"), F.concat(a["out"], apart).alias("out"))

    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    clean = F.aggregate(spans, start, step, lambda a: F.concat(a["out"], F.substring(F.col(text), a["at"] + 1, F.char_length(text))))
    joined = named.join(found, F.col(name) == F.col(blob), "left")
    return joined.withColumn(text, F.when(F.size(spans) > 0, clean).otherwise(F.col(text))).select(*columns)
