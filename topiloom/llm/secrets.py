"""Secret scans over an incremental ledger of content-addressed blobs.

Every historical version of a text is a *path* (a document row) that points at a
*blob*, named by the SHA-256 of its content.  A stored ledger tells which pairs of blob
and rule version have been scanned, with what result.  A scan

1. names the blob of every path (:func:`name_paths`),
2. keeps one copy of each blob and drops the pairs that the ledger knows,
3. runs the rules over what is left and appends the results (:func:`update`), and
4. joins all findings, old and new, back to all paths (:func:`found_in`).

So a text that occurs a thousand times, or in a thousand versions, is scanned once
per rule version, and a new rule version scans for its own rules only.  All of it is
DataFrame expressions; no Python runs on rows.

A text can only hold a finding if some rule's pattern occurs in it.  That is tested where
the text is read; only texts that pass are shuffled, of all others only the names.

The rules are leftmost, non-overlapping matches of fixed patterns, with conditions
on the matched text; positions are code points, end exclusive.  Spark returns the
texts of all matches but not their places; these are running sums of the lengths of
matches and of the pieces between them, so work grows in proportion to findings.

A blob that very many paths share is joined back in salted parts.

Defined cases: a null text is the empty blob; repeated rows and equal or null ids
are paths of their own; a pair that the ledger holds more than once counts once; an
empty table gives no rows; other columns are ignored, and kept by :func:`redact`.
"""

from __future__ import annotations

import dataclasses

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from topiloom.llm.common import cut, field, from_row, salted


@dataclasses.dataclass(frozen=True)
class Rule:
    kind: str
    pattern: str  # Java and RE2 syntax alike
    least: int  # characters of group 1; 0: the pattern says it all
    cues: tuple[str, ...]  # every match holds one of these, ``fold``: once A-Z are lower-cased
    fold: bool = False


# The three base rules, in the order in which their kinds are listed.
# A least length of one repeated class stands in the pattern: a run that is too
# short matches nothing and longer ones match as before.  A short value of an
# assignment does take its characters, so that length is tested afterwards.
BASE_RULES = (
    Rule(
        "assign",
        r"""(?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
        6,
        ("passw", "secret", "token", "api"),
        fold=True,
    ),
    Rule("access", r"AKIA[A-Z0-9]{16,}", 0, ("AKIA",)),
    Rule("hex", r"[0-9a-f]{24,}", 0, ()),
)

# Published forms of further credentials, listed after the base rules.
EXTRA_RULES = (
    Rule("key", r"-----BEGIN (?:[A-Z]+ )*PRIVATE KEY-----[A-Za-z0-9+/=\x20\r\n]*", 0, ("PRIVATE KEY-----",)),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}", 0, ("ghp_", "gho_", "ghu_", "ghs_", "ghr_")),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}", 0, ("xox",)),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", 0, ("eyJ",)),
)


@dataclasses.dataclass(frozen=True)
class RuleSet:
    version: str
    rules: tuple[Rule, ...]
    first: int = 0  # rank of the first rule among those of all sets


BASE = RuleSet("base-1", BASE_RULES)
EXTRA = RuleSet("extra-1", EXTRA_RULES, len(BASE_RULES))
RULE_SETS = (BASE, EXTRA)

FINDINGS = "array<struct<start:int,rank:int,stop:int,kind:string>>"
LEDGER = f"blob binary, rule_version string, found {FINDINGS}"
_PIECES = "array<struct<rank:int,kind:string,gap:int,size:int,counts:boolean>>"
_CHUNK = 4096


class Ledger:
    """The stored ledger: a folder of Parquet files, to which scans append."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def append(self, rows: DataFrame) -> None:
        rows.write.mode("append").option("compression", "zstd").parquet(self.folder)

    def rows(self) -> DataFrame:
        """(blob, rule_version, found), each pair once, however often an interrupted or
        overlapping run has written it."""
        hadoop = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.folder)
        if not hadoop.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop):
            return self.spark.createDataFrame([], LEDGER)
        return self.spark.read.schema(LEDGER).parquet(self.folder).dropDuplicates(["blob", "rule_version"])


def _occurs(text: Column, rule: Rule) -> Column:
    """Whether the rule's pattern matches anywhere; what it needs is looked for first."""
    searched = F.lower(text) if rule.fold else text
    cue = F.lit(not rule.cues)
    for c in rule.cues:
        cue |= searched.contains(c)
    return cue & text.rlike(rule.pattern)


def suspect(text: Column, rule_sets: tuple[RuleSet, ...] = RULE_SETS) -> Column:
    """Whether any rule's pattern occurs in ``text``: without that there is no finding."""
    out = F.lit(False)
    for rule_set in rule_sets:
        for rule in rule_set.rules:
            out |= _occurs(text, rule)
    return out


def _matches(text: Column, rule: Rule, rank: int) -> Column:
    """All matches of one rule, with the lengths before and of each, and whether it counts."""
    whole = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0))
    measured = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(1)) if rule.least else whole
    gaps = F.slice(F.split(text, rule.pattern, -1), 1, F.size(whole))
    pieces = F.zip_with(
        F.zip_with(gaps, whole, lambda gap, m: F.struct(F.length(gap).alias("gap"), F.length(m).alias("size"))),
        measured,
        lambda p, m: F.struct(F.lit(rank).alias("rank"), F.lit(rule.kind).alias("kind"), p["gap"].alias("gap"), p["size"].alias("size"), (F.length(m) >= rule.least).alias("counts")),
    )
    return F.when(_occurs(text, rule), pieces.cast(_PIECES)).otherwise(F.array().cast(_PIECES))


def _blob(text: Column) -> Column:
    return F.unhex(F.sha2(F.coalesce(text, F.lit("")), 256))


def name_paths(docs: DataFrame, rule_sets: tuple[RuleSet, ...] = RULE_SETS) -> DataFrame:
    """(doc_id, blob, text): a stored table of every path of ``docs`` (doc_id, text), with
    the text only where a rule may find something."""
    text = F.col("text").cast("string")
    return cut(docs.select(F.col("doc_id").alias("doc_id"), _blob(text).alias("blob"), F.when(suspect(text, rule_sets), text).alias("text")), "paths")


def scan(paths: DataFrame, known: DataFrame | None = None, rule_sets: tuple[RuleSet, ...] = RULE_SETS) -> DataFrame:
    """New ledger rows (blob, rule_version, found): one for each pair of a blob of ``paths``
    (blob, text) and a version of ``rule_sets`` that ``known`` (a ledger) does not have."""
    versions = [r.version for r in rule_sets]
    blobs = paths.groupBy("blob").agg(F.first("text", ignorenulls=True).alias("text"))
    done = F.array().cast("array<string>")
    if known is not None:
        seen = known.where(F.col("rule_version").isin(versions)).groupBy(F.col("blob").alias("_blob")).agg(F.collect_set("rule_version").alias("seen"))
        blobs = blobs.join(seen, F.col("blob") == F.col("_blob"), "left")
        done = F.coalesce("seen", done)
    pieces = lambda r: F.when(F.col("text").isNotNull(), F.concat(*(_matches(F.col("text"), rule, r.first + i) for i, rule in enumerate(r.rules)))).otherwise(F.array().cast(_PIECES))
    work = F.filter(F.array(*(F.when(~F.array_contains(done, r.version), F.struct(F.lit(r.version).alias("version"), pieces(r).alias("pieces"))) for r in rule_sets)), lambda w: w.isNotNull())
    pairs = blobs.select("blob", F.explode(work).alias("w")).select("blob", F.col("w.version").alias("rule_version"), F.posexplode_outer("w.pieces").alias("place", "p"))
    # rows of a blob are together already; the sums need no further shuffle
    upto = Window.partitionBy("blob", "rule_version", "p.rank").orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
    placed = pairs.withColumn("stop", F.sum(F.col("p.gap") + F.col("p.size")).over(upto).cast("int"))
    finding = F.when(F.col("p.counts"), F.struct((F.col("stop") - F.col("p.size")).alias("start"), F.col("p.rank").alias("rank"), F.col("stop").alias("stop"), F.col("p.kind").alias("kind")))
    return placed.groupBy("blob", "rule_version").agg(F.array_sort(F.collect_list(finding)).cast(FINDINGS).alias("found"))


def update(ledger: Ledger, paths: DataFrame, rule_sets: tuple[RuleSet, ...] = RULE_SETS) -> None:
    """Scans what the ledger does not know yet and appends it."""
    ledger.append(scan(paths, ledger.rows(), rule_sets))


def found_in(paths: DataFrame, ledger: DataFrame, rule_sets: tuple[RuleSet, ...] = RULE_SETS) -> DataFrame:
    """(doc_id, blob, found) for every row of :func:`name_paths`; ``found`` maps rule
    versions to findings, those that found nothing left out."""
    versions = [r.version for r in rule_sets]
    hits = ledger.where(F.col("rule_version").isin(versions) & (F.size("found") > 0))
    hits = hits.groupBy("blob").agg(F.map_from_entries(F.collect_list(F.struct("rule_version", "found"))).alias("found"))
    none = F.lit(None).cast(f"map<string,{FINDINGS}>")
    may = paths.where("text IS NOT NULL").select("doc_id", "blob")
    back = salted(may, "blob", hits.withColumnRenamed("blob", "_key"), paths.count()).select("doc_id", "blob", "found")
    return back.unionByName(paths.where("text IS NULL").select("doc_id", "blob", none.alias("found")))


def report(found: DataFrame) -> DataFrame:
    """Counts and digests of :func:`found_in`: base rules by themselves, and the spans of all rules."""
    none = F.array().cast(FINDINGS)
    base = F.coalesce(F.try_element_at("found", F.lit(BASE.version)), none)
    every = F.coalesce(F.array_sort(F.flatten(F.map_values("found"))), none)
    joined = lambda spans: F.array_join(F.transform(spans, lambda f: F.concat_ws(":", f["kind"], f["start"].cast("string"), f["stop"].cast("string"))), ",")
    count = lambda kind: F.size(F.filter(base, lambda f: f["kind"] == kind)).cast("long")
    return found.select(
        "doc_id",
        count("assign").alias("n_assign"),
        count("access").alias("n_access"),
        count("hex").alias("n_hex"),
        F.sha2(joined(base), 256).alias("base_sha256"),
        joined(every).alias("spans"),
    )


def _between(chunks: Column, start: Column, stop: Column) -> Column:
    """Code points [start, stop) of a text in chunks: no chunk is walked for another's sake."""
    a, b = F.floor(start / _CHUNK).cast("int"), F.floor(stop / _CHUNK).cast("int")
    chunk = lambda i: F.coalesce(F.get(chunks, i), F.lit(""))
    inside = F.substring(chunk(a), start % _CHUNK + 1, stop - start)
    across = F.concat(F.substring(chunk(a), start % _CHUNK + 1, F.lit(_CHUNK)), F.array_join(F.slice(chunks, a + 2, F.greatest(b - a - 1, F.lit(0))), ""), F.substring(chunk(b), F.lit(1), stop % _CHUNK))
    return F.when(a == b, inside).otherwise(across)


def redact(docs: DataFrame, mark: str = "[SECRET]", rule_sets: tuple[RuleSet, ...] = RULE_SETS) -> DataFrame:
    """``docs`` (doc_id, text, n_chars) with every finding replaced in the text, and n_chars
    to match; overlapping findings become one mark.

    Texts without a match of any pattern stay where they are; the others move.
    """
    text = F.col("text").cast("string")
    wide = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), suspect(text, rule_sets).alias("_suspect"))
    clean = from_row(wide.where(~F.coalesce("_suspect", F.lit(False))), docs.columns)
    dirty = cut(wide.where("_suspect").select("row", _blob(field("text").cast("string")).alias("blob")), "suspects")
    found = scan(dirty.select("blob", field("text").cast("string").alias("text")), None, rule_sets)
    spans = found.select("blob", F.explode("found").alias("f"))
    before = Window.partitionBy("blob").orderBy("f.start", "f.rank", "f.stop").rowsBetween(Window.unboundedPreceding, -1)
    apart = spans.withColumn("at", F.coalesce(F.max("f.stop").over(before), F.lit(0)))
    gap = F.when(F.col("f.start") >= F.col("at"), F.struct("at", F.col("f.start").alias("start")))
    gaps = apart.groupBy("blob").agg(F.array_sort(F.collect_list(gap)).alias("gaps"), F.max("f.stop").alias("last"))
    told = salted(dirty, "blob", gaps.withColumnRenamed("blob", "_key"), dirty.count()).withColumn("chunks", F.when(F.col("last").isNotNull(), F.regexp_extract_all(field("text"), F.lit(f"(?s).{{1,{_CHUNK}}}"), F.lit(0))))
    pieces = F.transform("gaps", lambda g: F.concat(_between(F.col("chunks"), g["at"], g["start"]), F.lit(mark)))
    rest = _between(F.col("chunks"), F.col("last"), F.length(field("text")))
    told = told.withColumn("new", F.concat(F.array_join(pieces, ""), rest))
    changed = F.col("new").isNotNull()
    instead = {"text": F.coalesce("new", field("text"))}
    if "n_chars" in docs.columns:
        instead["n_chars"] = F.when(changed, F.length("new").cast(docs.schema["n_chars"].dataType)).otherwise(field("n_chars"))
    return clean.unionByName(from_row(told, docs.columns, **instead))
