"""Secret scans by an incremental blob ledger.

Every version of a document is addressed by the SHA-256 of its content. A ledger holds the (blob, rule set version) pairs
already scanned; only pairs that it lacks are scanned, and findings, which are kept per blob, are joined back to every
path (doc_id) that ever held the blob. Ledger and findings are tables that outlive a run; all of it is DataFrame
expressions.

Defined results: a null text is the empty text; null or repeated ids are kept, a row each; equal texts are scanned once;
a text of any length is scanned whole, in time linear in its matches; other columns of the input are ignored, whatever
their names; an empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Workspace, table


@dataclass(frozen=True)
class Rule:
    """A kind of secret: pattern, group that min_chars is held against (0: the match), whether it counts as a base kind."""

    kind: str
    pattern: str
    group: int = 0
    min_chars: int = 1
    base: bool = True


#: The base kinds in the order in which ties are listed. `access` and `hex` state their least length in the
#: pattern: both take a maximal run of a character class, so a run that is too short holds no other match.
BASE_RULES = (
    Rule("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    Rule("access", r"AKIA[A-Z0-9]{14,}"),
    Rule("hex", r"[0-9a-f]{16,}"),
)
#: Further kinds that the ledger's rule set adds.
ADDED_RULES = (
    Rule("pem", r"-----BEGIN (?:RSA |EC |DSA |OPENSSH )?PRIVATE KEY-----", base=False),
    Rule("github", r"gh[oprsu]_[A-Za-z0-9]{36,}", base=False),
)
RULES = BASE_RULES + ADDED_RULES
RULES_VERSION = "1"
#: Places that the findings of a blob are dealt to, for the look-up of its paths.
SALTS = 8
EMPTY_SHA256 = "e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855"


def _hits(text: Column, rule: Rule, order: int) -> Column:
    """array<struct<kind,k,gap,hit,held>> of a rule's matches: lengths of what is before each, of itself and of its group."""
    gaps = F.split(text, F.lit(rule.pattern), -1)
    hits = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0))
    held = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(rule.group)) if rule.group else hits
    parts = F.transform(
        F.arrays_zip(gaps.alias("gap"), hits.alias("hit"), held.alias("held")),
        lambda p, k: F.struct(F.lit(order).alias("kind"), k.alias("k"), F.length(p["gap"]).alias("gap"), F.length(p["hit"]).alias("hit"), F.length(p["held"]).alias("held")),
    )
    found = F.filter(parts, lambda p: p["hit"].isNotNull())  # the last gap has no match after it
    return F.when(text.rlike(rule.pattern), found).otherwise(F.array().cast("array<struct<kind:int,k:int,gap:int,hit:int,held:int>>"))


def address(docs: DataFrame) -> DataFrame:
    """doc_id, text ('' for null), blob: the content address."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select("doc_id", text.alias("text"), F.sha2(text, 256).alias("blob"))


def scan(blobs: DataFrame) -> DataFrame:
    """blob, rules_version, spans (array<struct<start,kind,end>>, code points): the findings of distinct blobs (blob, text).

    Gaps and matches alternate in a text, so the running sum of their lengths places each match: a window over the
    matches of a blob, which is linear in them.
    """
    hits = F.concat(*[_hits(F.col("text"), rule, k) for k, rule in enumerate(RULES)])
    rows = blobs.select("blob", F.explode(hits).alias("m")).select("blob", "m.*")
    before = Window.partitionBy("blob", "kind").orderBy("k").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    end = F.sum(F.col("gap") + F.col("hit")).over(before).cast("int")
    least = F.element_at(F.array(*[F.lit(r.min_chars) for r in RULES]), F.col("kind") + 1)
    placed = rows.select("blob", "kind", "hit", "held", end.alias("end")).filter(F.col("held") >= least)
    spans = F.array_sort(F.collect_list(F.struct((F.col("end") - F.col("hit")).alias("start"), "kind", "end")))
    return placed.groupBy("blob").agg(spans.alias("spans")).select("blob", F.lit(RULES_VERSION).alias("rules_version"), "spans")


def unseen(addressed: DataFrame, ledger: DataFrame | None) -> DataFrame:
    """The distinct blobs whose pair with the current rule set is not in the ledger (blob, rules_version)."""
    blobs = addressed.select("blob", "text").dropDuplicates(["blob"])
    if ledger is None:
        return blobs
    done = ledger.filter(F.col("rules_version") == RULES_VERSION).select("blob")
    return blobs.join(done, "blob", "left_anti")


class Ledger:
    """The pairs (blob, rules_version) that have been scanned, and their findings, as Parquet under a shared folder.

    A run adds one folder to each: the findings first, then the pairs, so that a run which dies in between is scanned
    again and its findings count once.
    """

    PAIRS, FINDINGS = "blob string, rules_version string", "blob string, rules_version string, spans array<struct<start:int,kind:int,end:int>>"

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _read(self, name: str, schema: str) -> DataFrame:
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
        if not path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(f"{self.root}/{name}")

    def pairs(self) -> DataFrame:
        return self._read("pairs", self.PAIRS)

    def findings(self) -> DataFrame:
        return self._read("findings", self.FINDINGS).dropDuplicates(["blob", "rules_version"])

    def update(self, docs: DataFrame) -> None:
        """Scans the versions that the ledger lacks, and enters them."""
        addressed = address(docs)
        done = self.pairs()
        scan(unseen(addressed, done)).write.mode("append").parquet(f"{self.root}/findings")
        new = addressed.select("blob").distinct().select("blob", F.lit(RULES_VERSION).alias("rules_version"))
        new.join(done, ["blob", "rules_version"], "left_anti").write.mode("append").parquet(f"{self.root}/pairs")


def join_back(docs: DataFrame, findings: DataFrame) -> DataFrame:
    """Every row of docs with the spans of its blob: doc_id, n_<kind> per base kind, base_sha256, spans.

    A blob may have a large part of all paths, so a finding is dealt to SALTS places, and each path looks it up in one.
    """
    found = findings.filter(F.col("rules_version") == RULES_VERSION)
    kinds = F.array(*[F.lit(r.kind) for r in RULES])
    n_base = len(BASE_RULES)
    said = lambda spans: F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", F.element_at(kinds, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))))
    count = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long")
    digest = found.select(
        "blob",
        *[count(k).alias(f"n_{r.kind}") for k, r in enumerate(BASE_RULES)],
        F.sha2(said(F.filter("spans", lambda s: s["kind"] < n_base)), 256).alias("base_sha256"),
        said(F.col("spans")).alias("said"),
    ).withColumn("salt", F.explode(F.array(*[F.lit(k) for k in range(SALTS)])))
    paths = address(docs).select("doc_id", "blob", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int").alias("salt"))
    return paths.join(digest, ["blob", "salt"], "left").select(
        "doc_id",
        *[F.coalesce(f"n_{r.kind}", F.lit(0).cast("long")).alias(f"n_{r.kind}") for r in BASE_RULES],
        F.coalesce("base_sha256", F.lit(EMPTY_SHA256)).alias("base_sha256"),
        F.coalesce("said", F.lit("")).alias("spans"),
    )


def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    ledger = Ledger(spark, Workspace(spark, "op9").root)
    ledger.update(docs)
    return join_back(docs, ledger.findings())


def _oracle() -> str:
    """The same spans in SQL. RE2 folds case beyond ASCII, so letters are spelt out in both cases."""
    fold = lambda word: "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)
    words = "|".join(fold(w) for w in ("password", "passwd", "secret", "token", "api_?key"))
    patterns = [f"({words})[\"'']?\\x20*[:=]\\x20*[\"'']?([A-Za-z0-9+/_.=-]+)", *(r.pattern for r in RULES[1:])]
    kinds = " UNION ALL ".join(
        f"SELECT doc_id, '{r.kind}' kind, {k} ord, {r.min_chars} least, string_split_regex(t, '{p}') gaps, regexp_extract_all(t, '{p}', 0) hits, regexp_extract_all(t, '{p}', {r.group}) held FROM d"
        for k, (r, p) in enumerate(zip(RULES, patterns, strict=True))
    )
    counts = ", ".join(f"count(*) FILTER (kind = '{r.kind}') n_{r.kind}" for r in BASE_RULES)
    zeros = ", ".join(f"CAST(coalesce(n_{r.kind}, 0) AS BIGINT) n_{r.kind}" for r in BASE_RULES)
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') t FROM documents), m AS ({kinds}),
s AS (SELECT doc_id, kind, ord, least, CAST(list_sum(list_transform(gaps[1:k], lambda x: length(x))) + coalesce(list_sum(list_transform(hits[1:k - 1], lambda x: length(x))), 0) AS BIGINT) a, length(hits[k]) n, length(held[k]) h
  FROM (SELECT *, unnest(range(1, len(hits) + 1)) k FROM m)),
f AS (SELECT doc_id, kind, ord, a, kind || ':' || a || ':' || (a + n) said FROM s WHERE h >= least),
g AS (SELECT doc_id, {counts}, sha256(coalesce(string_agg(said, ',' ORDER BY a, ord) FILTER (ord < {len(BASE_RULES)}), '')) b, string_agg(said, ',' ORDER BY a, ord) spans FROM f GROUP BY doc_id)
SELECT d.doc_id, {zeros}, coalesce(b, sha256('')) base_sha256, coalesce(spans, '') spans FROM d LEFT JOIN g USING (doc_id)
"""


OP9_SQL = _oracle()
