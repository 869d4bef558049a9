"""Secret scans (operator 5): an incremental ledger of content-addressed blobs.

A version of a document is a path (its id) and a blob, named by the SHA-256 of its text; a path may have any number of
versions.  The ledger holds, for each blob and rule version, what a scan found.  Only pairs of a blob and a rule version that
the ledger lacks are scanned, each once, however many paths or historical versions carry the blob: the smallest path supplies
its text.  New rules get a new version of their own, so what older rules found is not scanned again.  Findings are then
joined back to every path.

Names (path, blob) are small and counted first.  Texts are scanned where they are read: what tells rows to scan from the others
(the pairs wanted, or where most are wanted the blobs that need care, since several rows have them or the ledger knows
them in part) is broadcast if it was counted and is small.  Only beyond that do texts move, to meet the pairs wanted.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cellweave.llm.common import EMPTY_SHA256, bounded_rows, maybe_broadcast, pieces, read_table
from cellweave.sources.shared import materialise, shared_dir

#: By rule version: kinds in order, their patterns, which group is measured, and its least length.  A match that is too short
#: is dropped and still uses up its characters.  Never change a version; add one.
RULES = {
    1: (
        ("assign", r"""(?ai:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
        ("access", r"AKIA[A-Z0-9]+", 0, 16),
        ("hex", r"[0-9a-f]+", 0, 32),
    ),
    2: (
        ("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----[A-Za-z0-9+/=\x20\x09-\x0D]*-----END [A-Z ]*PRIVATE KEY-----", 0, 1),
        ("url", r"""://[^\x00-\x20/:@"'<>]+:[^\x00-\x20/@"'<>]+@""", 0, 1),
        ("jwt", r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", 0, 40),
        ("github", r"gh[pousr]_[A-Za-z0-9]+", 0, 40),
        ("slack", r"xox[abprs]-[A-Za-z0-9-]+", 0, 20),
    ),
}
KINDS = [rule[0] for version in sorted(RULES) for rule in RULES[version]]
BASE_KINDS = tuple(rule[0] for rule in RULES[1])
REDACTED = "[secret]"
#: Blobs with findings, or that tell what to scan, are broadcast up to this many (some hundred bytes each).
BROADCAST_BLOBS = 50_000

#: Patterns that would be tried anew all along a run of their own characters, as ones that are tried once a run: only if what has
#: to follow the run is there, and then from the first start in it on.  The match is the group ``m``; spans are the same.
_ONCE_A_RUN = {
    RULES[2][2][1]: r"(?<![A-Za-z0-9_-])(?=[A-Za-z0-9_-]++\.eyJ[A-Za-z0-9_-]++\.[A-Za-z0-9_-])[A-Za-z0-9_-]*?(?P<m>eyJ[A-Za-z0-9_-]++\.eyJ[A-Za-z0-9_-]++\.[A-Za-z0-9_-]++)",
}

LEDGER_SCHEMA = "blob string, rule_version int, spans array<struct<kind:string,start:int,end:int>>"
SPAN = pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())])


def _scanner(rules):
    compiled = []
    for kind, pattern, group, least in rules:
        if pattern == r"[0-9a-f]+":  # whole runs either way: only long ones need be met
            pattern = rf"[0-9a-f]{{{least},}}"
        if pattern in _ONCE_A_RUN:
            pattern, group = _ONCE_A_RUN[pattern], "m"
        compiled.append((kind, re.compile(pattern), group, "m" if group == "m" else 0, least))

    def scan(text: str) -> list[tuple[str, int, int]]:
        found = []
        for order, (kind, pattern, group, whole, least) in enumerate(compiled):
            for m in pattern.finditer(text):
                if m.end(group) - m.start(group) >= least:
                    found.append((m.start(whole), order, kind, m.end(whole)))
        found.sort()
        return [(kind, start, end) for start, _, kind, end in found]

    return scan


def scan_blobs(blobs: DataFrame, rules: dict[int, tuple] = RULES) -> DataFrame:
    """Ledger entries for rows (blob, text, missing, many): one for each rule version in ``missing``, without spans if clean.

    Of rows with the same blob (``many``), a task scans the first.
    """

    def scan_all(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scans = {version: _scanner(x) for version, x in rules.items()}
        done: set[str] = set()
        for part in pieces(batches, "text"):
            out: list[list] = [[], [], []]
            for blob, text, missing, many in zip(*(part.column(c).to_pylist() for c in ("blob", "text", "missing", "many")), strict=True):
                if many:
                    if blob in done:
                        continue
                    done.add(blob)
                for version in missing:
                    for column, value in zip(out, (blob, version, [{"kind": k, "start": s, "end": e} for k, s, e in scans[version](text or "")]), strict=True):
                        column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(out, (pa.string(), pa.int32(), pa.list_(SPAN)), strict=True)], ["blob", "rule_version", "spans"])

    return blobs.select("blob", "text", "missing", "many").mapInArrow(scan_all, LEDGER_SCHEMA)


def blob_name(text) -> Column:
    return F.sha2(F.coalesce(text, F.lit("")), 256)


def _path(ident) -> Column:
    return F.coalesce(ident.cast("string"), F.lit(""))


def name_versions(versions: DataFrame) -> DataFrame:
    """``path, blob`` of versions (path, text), written once."""
    return materialise(versions.select("path", blob_name(F.col("text")).alias("blob")), "names")


def new_ledger_entries(versions: DataFrame, ledger: DataFrame | None = None, rules: dict[int, tuple] = RULES, names: DataFrame | None = None) -> DataFrame:
    """Scan what ``ledger`` lacks of the blobs of ``versions`` (path, text) and the versions of ``rules``; the new entries.

    Append the result to the ledger.  Null texts are the empty blob, null paths the empty path; repeated rows are scanned
    once a task at most, other rows with equal texts not at all.  An empty table gives no entries.
    """
    names = name_versions(versions) if names is None else names
    every = F.array(*[F.lit(v) for v in sorted(rules)]).cast("array<int>")
    blobs = names.groupBy("blob").agg(F.min(_path(F.col("path"))).alias("_path"), (F.count(F.lit(1)) > 1).alias("many"))
    if ledger is None:
        blobs = blobs.withColumn("missing", every)
    else:
        seen = ledger.groupBy(F.col("blob").alias("_seen")).agg(F.collect_set("rule_version").alias("seen"))
        none = F.array().cast("array<int>")
        blobs = blobs.join(seen, F.col("blob") == F.col("_seen"), "left").withColumn("missing", F.array_except(every, F.coalesce("seen", none))).drop("_seen", "seen")
    blobs = materialise(blobs, "blobs").withColumnRenamed("blob", "_blob")
    texts = versions.select(_path(F.col("path")).alias("path"), blob_name(F.col("text")).alias("blob"), "text")
    wanted, careful = blobs.where(F.size("missing") > 0), blobs.where(F.col("many") | (F.size("missing") < F.size(every)))
    supplied = F.col("path") == F.col("_path")
    if not bounded_rows(wanted, BROADCAST_BLOBS) and bounded_rows(careful, BROADCAST_BLOBS):
        met = texts.join(F.broadcast(careful), F.col("blob") == F.col("_blob"), "left").where(F.col("_blob").isNull() | (supplied & (F.size("missing") > 0)))
        met = met.withColumns({"missing": F.coalesce("missing", every), "many": F.coalesce("many", F.lit(False))})
    else:
        met = texts.join(maybe_broadcast(wanted, BROADCAST_BLOBS), (F.col("blob") == F.col("_blob")) & supplied)
    return scan_blobs(met, rules)


def _findings(ledger: DataFrame, rules: dict[int, tuple] = RULES) -> DataFrame:
    """``_blob, spans`` of the blobs with findings of any of the rules' versions: by start, then in the order of the kinds."""
    kinds = [rule[0] for version in sorted(rules) for rule in rules[version]]
    place = F.array(*[F.lit(k) for k in kinds])
    found = ledger.where(F.col("rule_version").isin(*rules) & (F.size("spans") > 0))
    # A blob may have met the scan by two rows of one path; its entries agree.
    found = found.groupBy("blob", "rule_version").agg(F.min("spans").alias("spans")).groupBy(F.col("blob").alias("_blob")).agg(F.flatten(F.collect_list("spans")).alias("spans"))
    keyed = F.transform("spans", lambda s: F.struct(s["start"].alias("start"), F.array_position(place, s["kind"]).alias("place"), s["kind"].alias("kind"), s["end"].alias("end")))
    back = F.transform(F.sort_array(keyed), lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end")))
    return found.select("_blob", back.alias("spans"))


def _digest(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def scan_versions(df: DataFrame, ledger_path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, blob, spans`` for every row: spans (kind, start, end) in code points, by start, then kind as in ``KINDS``.

    Brings the ledger stored at ``ledger_path`` up to date first (by default a new one in the shared folder) and joins its
    findings to every row.  Null text is the empty blob; texts of any length are scanned whole.  Repeated rows and null ids get
    a row each.  Paths with the same blob share its findings; other columns of ``df`` are not read; an empty table gives an
    empty result.
    """
    spark = df.sparkSession
    versions = df.select(df[id_col].alias("path"), df[text_col].alias("text"))
    names = name_versions(versions)
    ledger = update_ledger(versions, ledger_path or f"{shared_dir(spark).rstrip('/')}/ledger-{uuid.uuid4().hex}", "path", names=names)
    found = maybe_broadcast(materialise(_findings(ledger), "findings"), BROADCAST_BLOBS)
    none = F.array().cast("array<struct<kind:string,start:int,end:int>>")
    joined = names.join(found, F.col("blob") == F.col("_blob"), "left")
    return joined.select(F.col("path").alias("doc_id"), "blob", F.coalesce("spans", none).alias("spans"))


def redact(df: DataFrame, text_col: str = "text", length_col: str | None = None, ledger: DataFrame | None = None) -> DataFrame:
    """``df`` with every secret in its texts replaced by ``REDACTED``; all rows and columns stay.

    Overlapping spans are merged first.  Texts without secrets, null and empty texts included, are unchanged; ``length_col``
    is set to the new number of code points where a text changed.  Repeated rows stay; an empty table stays empty; columns
    may have any names.  With a ``ledger``, blobs that it knows are not scanned.
    """
    names = df.columns
    marked = df.select(*[df[c].alias(f"c{i}") for i, c in enumerate(names)])
    text = F.col(f"c{names.index(text_col)}")
    versions = marked.select(F.xxhash64(*marked.columns).alias("path"), text.alias("text"))
    entries = new_ledger_entries(versions, ledger)
    if ledger is not None:
        entries = entries.unionByName(ledger)
    entries = materialise(_findings(entries), "findings")
    # Few blobs have findings: counted and few, they go to the texts; otherwise texts and findings meet by blob.
    entries = maybe_broadcast(entries, BROADCAST_BLOBS)
    joined = marked.withColumn("_b", blob_name(text)).join(entries, F.col("_b") == F.col("_blob"), "left")
    cut = F.aggregate(
        "spans",
        F.struct(F.lit("").alias("out"), F.lit(0).alias("at")),
        lambda a, s: F.struct(
            F.when(s["start"] >= a["at"], F.concat(a["out"], F.substring(text, a["at"] + 1, s["start"] - a["at"]), F.lit(REDACTED))).otherwise(a["out"]).alias("out"),
            F.greatest(a["at"], s["end"]).alias("at"),
        ),
        lambda a: F.concat(a["out"], F.substring(text, a["at"] + 1, F.length(text))),
    )
    joined = joined.withColumn("_new", F.when(F.col("_blob").isNotNull(), cut))
    out = []
    for i, c in enumerate(names):
        value = F.col(f"c{i}")
        if c == text_col:
            value = F.coalesce("_new", value)
        elif c == length_col:
            value = F.when(F.col("_new").isNotNull(), F.length("_new").cast(df.schema[c].dataType)).otherwise(value)
        out.append(value.alias(c))
    return joined.select(*out)


def update_ledger(versions: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", rules: dict[int, tuple] = RULES, names: DataFrame | None = None) -> DataFrame:
    """Bring the ledger stored at ``path`` (made if it is not there) up to date with ``versions``; the stored ledger afterwards.

    A second run on the same versions and rules scans nothing and adds nothing.
    """
    spark = versions.sparkSession
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    there = target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target)
    ledger = spark.read.schema(LEDGER_SCHEMA).parquet(path) if there else None
    fresh = new_ledger_entries(versions.select(versions[id_col].alias("path"), versions[text_col].alias("text")), ledger, rules, names)
    fresh = materialise(fresh, "fresh")  # the ledger is read for it and must not change meanwhile
    fresh.groupBy("blob", "rule_version").agg(F.min("spans").alias("spans")).write.mode("append").parquet(path)
    return spark.read.schema(LEDGER_SCHEMA).parquet(path)


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in all ``documents`` by all rule versions, through a ledger that is empty before."""
    found = scan_versions(read_table(spark, sf_dir, "documents", "doc_id", "text"))
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    base = F.filter("spans", lambda s: s["kind"].isin(*BASE_KINDS))
    digest = F.when(F.size(base) == 0, F.lit(EMPTY_SHA256)).otherwise(F.sha2(_digest(base), 256))
    return found.select("doc_id", count("assign").alias("n_assign"), count("access").alias("n_access"), count("hex").alias("n_hex"), digest.alias("base_sha256"), _digest(F.col("spans")).alias("spans"))


def _sql_spans(kind: str, order: int, pattern: str, least: int, group: str) -> str:
    """DuckDB: matches with positions; the text between two matches is what splitting by the pattern leaves."""
    return rf"""
      SELECT rid, '{kind}' AS kind, {order} AS o, start, start + length(m) AS stop FROM (
        SELECT rid, m, length({group}) AS n,
               sum(length(gap)) OVER w + coalesce(sum(length(m)) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start
        FROM (SELECT rid, unnest(ms) AS m, unnest(gaps[1:len(ms)]) AS gap, generate_subscripts(ms, 1) AS i FROM (
          SELECT rid, regexp_extract_all(text, '{pattern}') AS ms, regexp_split_to_array(text, '{pattern}') AS gaps FROM d) WHERE len(ms) > 0)
        WINDOW w AS (PARTITION BY rid ORDER BY i)
      ) WHERE n >= {least}"""


_ASSIGN_KEY = "([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])"
_ASSIGN = _ASSIGN_KEY + r"""["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)"""

_ADDED = "".join(
    f"\n  UNION ALL {_sql_spans(kind, len(BASE_KINDS) + i, pattern.replace(chr(39), chr(39) * 2), least, 'm')}" for i, (kind, pattern, _, least) in enumerate(RULES[2])
)

ORACLE_SQL = rf"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents
), s AS (
  {_sql_spans("assign", 0, _ASSIGN, 8, f"regexp_extract(m, '{_ASSIGN}', 2)")}
  UNION ALL {_sql_spans("access", 1, "AKIA[A-Z0-9]+", 16, "m")}
  UNION ALL {_sql_spans("hex", 2, "[0-9a-f]+", 32, "m")}{_ADDED}
), a AS (
  SELECT rid, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access,
         count(*) FILTER (kind = 'hex') AS n_hex,
         string_agg(kind || ':' || start::BIGINT || ':' || stop::BIGINT, ',' ORDER BY start, o) FILTER (o < 3) AS base,
         string_agg(kind || ':' || start::BIGINT || ':' || stop::BIGINT, ',' ORDER BY start, o) AS spans
  FROM s GROUP BY rid
)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN a USING (rid)
"""
