"""Secret scans with an incremental blob ledger.

Every version of every path is addressed by the SHA-256 of its content.  The ledger holds, per
blob, which rule versions have scanned it and what they found.  A scan takes only the (blob, rule
version) pairs that the ledger lacks, appends their findings, and joins the findings of the
current rule versions back to all paths.  Copies of a text, in a run or across runs, are thus
scanned once.  All of it is built from DataFrame functions.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linkgraph.llm.common import find_spans, joined_spans, literal, materialize, scratch_path, text_or_empty


@dataclass(frozen=True)
class Rule:
    """``needs``: a pattern that any text with a match has; ``keep``: what a match must hold."""

    name: str
    version: int
    pattern: str
    needs: str = ""
    keep: str = ""

    @property
    def key(self) -> str:
        return f"{self.name}@{self.version}"


#: In the order in which spans with one start are listed.  The first three are the base rules.
_ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?+\x20*+[:=]\x20*+["']?+"""
RULES = (
    Rule("assign", 1, _ASSIGN + r"[A-Za-z0-9+/_.=-]++", r"(?i:passw|secret|token|api_?key)", _ASSIGN + r"[A-Za-z0-9+/_.=-]{8,}"),
    Rule("access", 1, r"AKIA[A-Z0-9]{12,}+", "AKIA"),
    Rule("hex", 1, r"[0-9a-f]{32,}+"),
    Rule("pem", 1, r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----", "-----BEGIN "),
    Rule("github", 1, r"(?<![A-Za-z0-9_])gh[opsur]_[A-Za-z0-9]{36,}+", "gh[opsur]_"),
    Rule("slack", 1, r"(?<![A-Za-z0-9_])xox[abprs]-[A-Za-z0-9-]{10,}+", "xox[abprs]-"),
    Rule("jwt", 1, r"(?<![A-Za-z0-9_])eyJ[A-Za-z0-9_-]{8,}+\.eyJ[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]++", r"\.eyJ"),
)
BASE = ("assign", "access", "hex")
_SPANS = "array<struct<start:int,rank:int,kind:string,end:int>>"
#: Due blobs whose addresses are broadcast at most: 64 digits and a few keys each.
DUE = 50_000
LEDGER = "blob string, scanned array<string>, found " + _SPANS


def _scan(text: str, rule: Rule, rank: int) -> str:
    spans = find_spans(text, rule.pattern, f"rlike({text}, {literal(rule.needs)})" if rule.needs else "true")
    if rule.keep:
        spans = f"filter({spans}, s -> rlike(s.value, {literal(f'^(?:{rule.keep})')}))"
    one = f"named_struct('start', s.start, 'rank', {rank}, 'kind', {literal(rule.key)}, 'end', s.end)"
    return f"coalesce(transform({spans}, s -> {one}), cast(array() as {_SPANS}))"


def read_ledger(spark: SparkSession, path: str) -> DataFrame:
    """The ledger's rows; none where it has not been begun."""
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(folder):
        return spark.read.schema(LEDGER).parquet(path)
    return spark.createDataFrame([], LEDGER)


def update_ledger(versions: DataFrame, content: str, ledger: str, rules: Sequence[Rule] = RULES) -> None:
    """Scan the (blob, rule version) pairs of ``versions`` that the ledger lacks and append them.

    Addresses go first: the distinct ones are held against the ledger without any text, and where
    nothing is due nothing else happens.  Only the bodies of due blobs are fetched, by a broadcast of
    their addresses where they are few (DUE at most, of 64 digits).  If every blob is due or they are
    many, texts are shuffled by address.  Either way copies meet before the shuffle already, so a hot
    blob is a row per scan task, and one body per blob is scanned.

    A batch is one append, committed by Spark's writer: a lost executor repeats its tasks, a failed
    job leaves the ledger as it was.  A null content is the empty blob.
    """
    spark = versions.sparkSession
    body = text_or_empty(content)
    blobs = versions.selectExpr(f"sha2(cast({body} as binary), 256) as blob", f"{body} as body")
    keys = f"array({', '.join(literal(r.key) for r in rules)})"
    known = read_ledger(spark, ledger).select("blob", F.explode("scanned").alias("key"))
    if known.isEmpty():
        batch = blobs.groupBy("blob").agg(F.first("body").alias("body")).selectExpr("*", f"{keys} as scanned")
    else:
        known = known.groupBy("blob").agg(F.collect_set("key").alias("seen"))  # as many keys as rules have versions
        asked = blobs.select("blob").distinct().join(known, "blob", "left")
        asked = asked.selectExpr("blob", f"array_except({keys}, coalesce(seen, array())) as scanned")
        due = materialize(asked.where("size(scanned) > 0"), "due")
        many = due.limit(DUE + 1).count()
        if not many:
            return
        if many <= DUE:
            due = F.broadcast(due)
            # the join drops what isn't due before copies meet and bodies move
            batch = blobs.join(due, "blob").groupBy("blob").agg(F.first("body").alias("body"), F.first("scanned").alias("scanned"))
        else:
            batch = blobs.groupBy("blob").agg(F.first("body").alias("body")).join(due, "blob")
    found = [f"if(array_contains(scanned, {literal(r.key)}), {_scan('body', r, i)}, cast(array() as {_SPANS}))" for i, r in enumerate(rules)]
    batch.selectExpr("blob", "scanned", f"concat({', '.join(found)}) as found").write.mode("append").parquet(ledger)


def findings(spark: SparkSession, ledger: str, rules: Sequence[Rule] = RULES) -> DataFrame:
    """blob, spans of the current rule versions, for blobs with any; kinds without their version.
    A pair that two runs have scanned at once stands in the ledger twice and counts once."""
    rank = F.create_map(*[x for i, r in enumerate(rules) for x in (F.lit(r.key), F.lit(i))])
    rows = read_ledger(spark, ledger).where(F.size("found") > 0).select("blob", F.explode("found").alias("s"))
    rows = rows.where(F.col("s.kind").isin(*[r.key for r in rules])).select(
        "blob",
        F.struct(
            F.col("s.start").alias("start"),
            rank[F.col("s.kind")].alias("rank"),
            F.substring_index("s.kind", "@", 1).alias("kind"),
            F.col("s.end").alias("end"),
        ).alias("s"),
    )
    # spans of one text; written, so that adaptive execution can split the join with the paths
    return materialize(rows.groupBy("blob").agg(F.array_sort(F.collect_set("s")).alias("secrets")), "findings")


def scan_secrets(
    versions: DataFrame, content: str = "text", ledger: str | None = None, rules: Sequence[Rule] = RULES
) -> DataFrame:
    """Append ``blob`` and ``secrets`` (array<struct<start,rank,kind,end>>) to every version.

    ``ledger`` is the path of the ledger table; without one a fresh ledger in the shared folder is
    begun.  Null and empty contents have no secrets; repeated rows each get their findings; further
    columns are carried (``blob`` and ``secrets`` are replaced).  The findings are joined by blob;
    a blob that very many paths share is split by adaptive execution's skew handling.
    """
    spark = versions.sparkSession
    path = ledger or scratch_path(spark, "ledger")
    update_ledger(versions, content, path, rules)
    addressed = versions.drop("secrets").withColumn("blob", F.expr(f"sha2(cast({text_or_empty(content)} as binary), 256)"))
    return addressed.join(findings(spark, path, rules), "blob", "left").withColumn(
        "secrets", F.coalesce("secrets", F.array().cast(_SPANS))
    )


def secrets_digest(docs: DataFrame, ledger: str | None = None) -> DataFrame:
    """Per document: counts of the base rules, the hash of the base spans, and all spans."""
    found = scan_secrets(docs.select("doc_id", "text"), "text", ledger)
    base = f"filter(secrets, s -> s.kind in ({', '.join(map(literal, BASE))}))"
    return found.selectExpr(
        "doc_id",
        *[f"cast(size(filter(secrets, s -> s.kind = '{k}')) as long) as n_{k}" for k in BASE],
        f"sha2(cast({joined_spans(base)} as binary), 256) as base_sha256",
        f"{joined_spans('secrets')} as spans",
        "blob",
    )
