"""Secret scans over an incremental blob ledger; DataFrame and SQL functions only."""

from __future__ import annotations

import hashlib
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import dropped, new_path, pick, table, written


@dataclass(frozen=True)
class Rule:
    """``hint``: a cheap pattern that every match's text meets. ``group``: the group that must have ``least`` characters."""

    kind: str
    pattern: str
    hint: str
    group: int = 0
    least: int = 1
    version: str = "1"

    @property
    def name(self) -> str:
        return f"{self.kind}:{self.version}"


#: In the order in which kinds are listed; the first three are the base.
RULES = [
    Rule("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", r"(?i:passw|secret|token|api_?key)", 2, 8),
    Rule("access", r"AKIA[A-Z0-9]+", "AKIA", 0, 16),
    Rule("hex", r"[0-9a-f]+", r"[0-9a-f]{32}", 0, 32),
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----", "PRIVATE KEY-----"),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}", r"gh[pousr]_"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}", r"xox[abprs]-"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", "eyJ"),
    Rule("url", r"[a-z][a-z0-9+.-]{1,20}://[^\s/:@]+:[^\s/:@]+@", "://"),
]
BASE = ("assign", "access", "hex")

SCANNED = "blob string, rules array<string>, batch string"
FINDINGS = "blob string, kind string, version string, start long, stop long, batch string"


class BlobLedger:
    """Which (blob, rule, rule version) have been scanned, and what was found; two append-only tables under ``path``.

    The first has a row a blob and batch with the rules (kind:version) scanned for, bucketed and sorted by blob, so that looking a new batch up does not
    shuffle the history. A batch's findings are written before its scanned rows, and only findings of batches that the scanned table
    names count: a run lost in between leaves no trace but unread files and is scanned again. ``path`` must be in storage that
    all executors share; ``buckets`` is fixed when the ledger is made and is kept beside it. ``close`` takes the table out of the session's catalogue, not its files.
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int | None = None):
        self.spark, self.path = spark, path
        self.name = "tidelog_ledger_" + hashlib.md5(path.encode()).hexdigest()[:16]
        meta = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/meta")
        if meta.getFileSystem(spark._jsc.hadoopConfiguration()).exists(meta):
            self.buckets = spark.read.parquet(f"{path}/meta").first()["buckets"]
        else:
            self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
            spark.createDataFrame([], FINDINGS).write.mode("append").parquet(f"{path}/findings")
            spark.range(1).select(F.lit(self.buckets).alias("buckets")).coalesce(1).write.parquet(f"{path}/meta")
        if not spark.catalog.tableExists(self.name):
            at = f"{path}/scanned".replace("'", "''")
            spark.sql(f"CREATE TABLE {self.name} (blob STRING, rules ARRAY<STRING>, batch STRING) USING parquet CLUSTERED BY (blob) SORTED BY (blob) INTO {self.buckets} BUCKETS LOCATION '{at}'")

    @property
    def rows(self) -> DataFrame:
        return self.spark.table(self.name)

    @property
    def scanned(self) -> DataFrame:
        """(blob, kind, version, batch): a row a scanned pair."""
        rule = F.split("rule", ":")
        return self.rows.select("blob", F.explode("rules").alias("rule"), "batch").select("blob", rule[0].alias("kind"), rule[1].alias("version"), "batch")

    @property
    def known(self) -> DataFrame:
        """(blob, known): all rules that a blob has been scanned for."""
        return self.rows.groupBy("blob").agg(F.flatten(F.collect_set("rules")).alias("known"))

    @property
    def findings(self) -> DataFrame:
        """What the batches that are complete have found."""
        found = self.spark.read.schema(FINDINGS).parquet(f"{self.path}/findings")
        return found.join(self.rows.select("blob", "batch"), ["blob", "batch"], "left_semi").select(*found.columns)

    def record(self, found: DataFrame, todo: DataFrame) -> None:
        batch = F.lit(uuid.uuid4().hex)
        found.select("blob", "kind", "version", "start", "stop", batch.alias("batch")).write.mode("append").parquet(f"{self.path}/findings")
        rows = todo.select("blob", "rules", batch.alias("batch")).repartition(self.buckets, "blob")
        rows.write.format("parquet").mode("append").bucketBy(self.buckets, "blob").sortBy("blob").saveAsTable(self.name)

    def close(self) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")


def spans(texts: DataFrame, rules: list[Rule]) -> DataFrame:
    """(blob, kind, version, start, stop) of ``texts`` (blob, names of the rules to scan for, text): per kind leftmost non-overlapping matches.

    A text is searched for the matches and cut at them; a rule's group is looked up in the short matches, not in the text again. A match's place comes from
    the lengths, in code points, of the pieces between matches and of the matches before it. A blob that comes more than once (rows that repeat both id and
    text) has equal matches each time, of which one set is kept before places are summed up.
    """
    each = []
    for r in rules:
        p, wanted = F.lit(r.pattern), F.array_contains("rules", r.name) & F.col("text").rlike(r.hint)
        found = F.when(wanted, F.regexp_extract_all("text", p, F.lit(0)))
        each.append(
            F.struct(
                F.lit(r.kind).alias("kind"),
                F.lit(r.version).alias("version"),
                F.lit(r.least).alias("least"),
                found.alias("m"),
                F.when(wanted, F.split("text", r.pattern, -1)).alias("s"),
            )
        )
    hit = texts.select("blob", F.inline(F.array(*each))).filter(F.size("m") > 0)
    hit = hit.select("blob", "kind", "version", "least", F.posexplode(F.arrays_zip("m", F.slice("s", F.lit(1), F.size("m")).alias("s"))).alias("i", "x"))
    group = F.length("x.m")
    for r in rules:
        if r.group:
            group = F.when(F.col("kind") == r.kind, F.length(F.regexp_extract("x.m", r.pattern, r.group))).otherwise(group)
    hit = hit.select("blob", "kind", "version", "least", "i", F.length("x.m").alias("lm"), group.alias("lg"), F.length("x.s").alias("ls"))
    hit = hit.dropDuplicates(["blob", "kind", "i"])
    run = Window.partitionBy("blob", "kind").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    hit = hit.withColumn("stop", F.sum(F.col("ls") + F.col("lm")).over(run).cast("long"))
    return hit.filter("lg >= least").select("blob", "kind", "version", (F.col("stop") - F.col("lm")).alias("start"), "stop")


def scan(docs: DataFrame, ledger: BlobLedger, rules: list[Rule] = RULES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, n_assign, n_access, n_hex, base_sha256, spans, findings (array of kind, start, stop).

    Each row is a version of a path. Its blob is the SHA-256 of its text (null counts as empty, which has no findings). Only pairs of
    blob and rule version that the ledger lacks are scanned, each once however many paths hold the blob, and the findings are joined
    back to all paths. Spans sort by start, then by the rules' order; kinds may overlap one another. Null ids and repeated rows are
    paths like any other. Empty input: no rows. A blob with very many paths meets its one row of findings in an exchanged equi-join,
    which adaptive execution splits.
    """
    plain = pick(docs, id_col, text_col).select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    named = plain.withColumn("blob", F.sha2("text", 256))
    paths = written(named.select("doc_id", "blob"), "paths")
    blobs = paths.groupBy("blob").agg(F.min("doc_id").alias("rep"))
    names = F.array(*[F.lit(r.name) for r in rules])
    work = blobs.join(ledger.known, "blob", "left").select("blob", "rep", F.array_except(names, F.coalesce("known", F.array().cast("array<string>"))).alias("rules"))
    todo = written(work.filter(F.size("rules") > 0), "todo")
    texts = named.join(todo.select(F.col("blob").alias("b"), "rep", "rules"), F.col("doc_id").eqNullSafe(F.col("rep")) & (F.col("blob") == F.col("b")))
    ledger.record(spans(texts.select("blob", "rules", "text"), rules), todo)
    dropped(todo)
    order = F.coalesce(*[F.when(F.col("kind") == r.kind, i) for i, r in enumerate(rules)])
    mine = F.concat_ws(":", "kind", "version").isin([r.name for r in rules])
    found = ledger.findings.filter(mine).groupBy("blob").agg(F.sort_array(F.collect_set(F.struct("start", order.alias("o"), "stop", "kind"))).alias("f"))
    found = written(found, "found")
    text = lambda c: F.array_join(F.transform(c, lambda x: F.concat_ws(":", x["kind"], x["start"], x["stop"])), ",")
    base = F.filter("f", lambda x: x["kind"].isin(*BASE))
    count = lambda k: F.size(F.filter("f", lambda x: x["kind"] == k)).cast("long").alias(f"n_{k}")
    out = paths.join(found, "blob", "left").withColumn("f", F.coalesce("f", F.expr("cast(array() as array<struct<start:bigint,o:int,stop:bigint,kind:string>>)")))
    return out.select(
        "doc_id",
        *[count(k) for k in BASE],
        F.sha2(text(base), 256).alias("base_sha256"),
        text(F.col("f")).alias("spans"),
        F.transform("f", lambda x: F.struct(x["kind"].alias("kind"), x["start"].alias("start"), x["stop"].alias("stop"))).alias("findings"),
    )


def op8_secret_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    ledger = BlobLedger(spark, new_path(spark, "secret-ledger"))
    found = scan(table(spark, sf_dir, "documents"), ledger).drop("findings")
    ledger.close()
    return found


def _sql(r: Rule, i: int) -> str:
    p = r.pattern.replace("'", "''")
    return f"""SELECT doc_id, {i} AS o, '{r.kind}' AS kind, {r.least} AS least, regexp_extract_all(t, '{p}', 0) AS m, regexp_extract_all(t, '{p}', {r.group}) AS g, regexp_split_to_array(t, '{p}') AS s FROM d WHERE regexp_matches(t, '{p}')"""


ORACLE = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
k AS ({" UNION ALL ".join(_sql(r, i) for i, r in enumerate(RULES))}),
e AS (SELECT doc_id, o, kind, least, unnest(range(1, len(m) + 1)) AS i, m, g, s FROM k),
f AS (SELECT doc_id, o, kind, list_sum([length(x) for x in s[1:i]]) + coalesce(list_sum([length(x) for x in m[1:i-1]]), 0) AS b, length(m[i]) AS n FROM e WHERE length(g[i]) >= least),
a AS (SELECT doc_id, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
  string_agg(kind || ':' || b::BIGINT || ':' || (b + n)::BIGINT, ',' ORDER BY b, o) FILTER (o < 3) AS base, string_agg(kind || ':' || b::BIGINT || ':' || (b + n)::BIGINT, ',' ORDER BY b, o) AS spans FROM f GROUP BY doc_id)
SELECT doc_id, coalesce(n_assign, 0)::BIGINT AS n_assign, coalesce(n_access, 0)::BIGINT AS n_access, coalesce(n_hex, 0)::BIGINT AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM documents LEFT JOIN a USING (doc_id)
"""
