"""One query per operator over the driver's tables, and the SQL that it must equal."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .functions import entries, formatting, matching, paths, versioning
from .operators import browse, candidates, deltas, diff, groups, hashing, migrate, regroup, rescan
from .plans import lifecycle, pipeline
from .sources import corpus
from .streaming import progress

N = corpus.SAMPLE

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

#: The files-shaped view in SQL, and the groups over it.
FILES = f"""
WITH base AS (
  SELECT doc_id AS id, CAST(substr(source, 4) AS BIGINT) AS root_id, '/scan/' || source AS root_path, lang || '/' || doc_id || '.txt' AS rel_path,
    CAST(strlen(text) AS BIGINT) AS size, doc_id * 1000000000 AS mtime_ns, CAST(1 AS BIGINT) AS device, sha256(text) AS full_hash, hex(encode(text)) AS hx,
    CASE WHEN doc_id % 17 = 0 THEN 'missing' ELSE 'present' END AS status
  FROM documents
), files AS (
  SELECT * EXCLUDE (hx), min(id) OVER (PARTITION BY full_hash, id % 2) AS inode,
    CASE WHEN size <= 3 * {N} THEN md5(hx) ELSE md5(substr(hx, 1, 2 * {N}) || substr(hx, 2 * (size // 2 - {N // 2}) + 1, 2 * {N}) || substr(hx, 2 * (size - {N}) + 1, 2 * {N})) END AS partial_hash
  FROM base
), usable AS (SELECT * FROM files WHERE status = 'present' AND size > 0
), groups AS (
  SELECT size, full_hash, count(*) AS member_count, count(DISTINCT device || '/' || inode) AS distinct_instance_count,
    (count(DISTINCT device || '/' || inode) - 1) * size AS reclaimable_bytes
  FROM usable GROUP BY size, full_hash HAVING count(*) > 1
), members AS (SELECT u.* FROM usable u JOIN groups g USING (size, full_hash)
), size_cand AS (SELECT * FROM usable WHERE size IN (SELECT size FROM usable GROUP BY size HAVING count(*) > 1)
), part_cand AS (SELECT * FROM size_cand WHERE (size, partial_hash) IN (SELECT (size, partial_hash) FROM size_cand GROUP BY size, partial_hash HAVING count(*) > 1)
), known AS (
  SELECT * REPLACE (size + CASE WHEN id % 7 = 0 THEN 1 ELSE 0 END AS size, CASE WHEN id % 13 = 0 THEN 'missing' ELSE 'present' END AS status) FROM files WHERE id % 10 <> 0
), walk AS (SELECT * FROM files WHERE id % 11 <> 0
), classified AS (
  SELECT coalesce(k.root_id, w.root_id) AS root_id, coalesce(k.rel_path, w.rel_path) AS rel_path, coalesce(w.size, k.size) AS size, coalesce(w.mtime_ns, k.mtime_ns) AS mtime_ns,
    k.full_hash AS old_hash,
    CASE WHEN k.id IS NULL THEN 'new' WHEN w.id IS NULL THEN CASE WHEN k.status = 'present' THEN 'missing' ELSE 'gone' END
      WHEN (k.size, k.mtime_ns, k.device, k.inode) IS DISTINCT FROM (w.size, w.mtime_ns, w.device, w.inode) THEN 'changed'
      WHEN k.status = 'missing' THEN 'reappeared' ELSE 'unchanged' END AS change_type
  FROM known k FULL OUTER JOIN walk w ON k.root_id = w.root_id AND k.rel_path = w.rel_path
), roots AS (SELECT DISTINCT CAST(substr(source, 4) AS BIGINT) AS id, '/scan/' || source AS path, source AS label, CAST(substr(source, 4) AS BIGINT) % 3 <> 0 AS enabled FROM documents
)
"""

#: Scans made of orders.
SCANS = """
WITH scans AS (
  SELECT o_orderkey AS id, o_orderdate AS started_at, CASE o_orderstatus WHEN 'F' THEN 'completed' WHEN 'O' THEN 'running' ELSE 'failed' END AS status,
    CASE WHEN o_orderstatus <> 'O' THEN o_orderdate + to_milliseconds(o_orderkey % 100000) END AS finished_at
  FROM orders
)
"""


def query(sql: str | None) -> Callable:
    """Registers a query under its function's name, with its SQL."""

    def register(f: Callable[[SparkSession, str], DataFrame]) -> Callable:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


def docs(spark: SparkSession, d: str) -> DataFrame:
    return spark.read.parquet(f"{d}/documents.parquet")


def files(spark: SparkSession, d: str) -> DataFrame:
    return corpus.files(docs(spark, d))


def unhashed(spark: SparkSession, d: str) -> DataFrame:
    """Files before any full hash is known."""
    return files(spark, d).withColumn("full_hash", F.lit(""))


def found_groups(spark: SparkSession, d: str) -> DataFrame:
    return groups.duplicate_groups(files(spark, d))


def scans(spark: SparkSession, d: str) -> DataFrame:
    o = spark.read.parquet(f"{d}/orders.parquet")
    status = F.when(F.col("o_orderstatus") == "F", "completed").when(F.col("o_orderstatus") == "O", "running").otherwise("failed")
    end = F.timestamp_millis(F.unix_millis(F.col("o_orderdate").cast("timestamp")) + F.col("o_orderkey") % 100000)
    return o.select(F.col("o_orderkey").alias("id"), F.col("o_orderdate").cast("timestamp").alias("started_at"), status.alias("status"), F.when(F.col("o_orderstatus") != "O", end).alias("finished_at"))


def classified(spark: SparkSession, d: str) -> DataFrame:
    all_files = files(spark, d)
    return diff.classify(corpus.known_files(all_files).withColumn("updated_at", F.lit(0)), corpus.walked_files(all_files))


# ------------------------------------------------------------------ files and candidates


@query(FILES + "SELECT id, root_id, root_path, rel_path, size, mtime_ns, device, inode, partial_hash, full_hash, status FROM files")
def files_view(spark, d):  # noqa: ANN001, ANN201
    return files(spark, d).select("id", "root_id", "root_path", "rel_path", "size", "mtime_ns", "device", "inode", "partial_hash", "full_hash", "status")


@query(FILES + "SELECT id, size FROM size_cand")
def size_candidates(spark, d):  # noqa: ANN001, ANN201
    return candidates.size_candidates(corpus.plain_files(docs(spark, d))).select("id", "size")


@query(FILES + "SELECT id, size, partial_hash FROM part_cand")
def partial_candidates(spark, d):  # noqa: ANN001, ANN201
    return pipeline.sample_stage(corpus.plain_files(docs(spark, d)), N).select("id", "size", "partial_hash")


@query(FILES + "SELECT id, size FROM usable WHERE size IN (SELECT size FROM usable GROUP BY size HAVING count(*) = 1)")
def size_singletons(spark, d):  # noqa: ANN001, ANN201
    return candidates.size_singletons(corpus.plain_files(docs(spark, d))).select("id", "size")


@query(FILES + "SELECT id, size FROM size_cand WHERE id NOT IN (SELECT id FROM part_cand)")
def partial_false_positives(spark, d):  # noqa: ANN001, ANN201
    staged = candidates.size_candidates(unhashed(spark, d))
    return staged.join(candidates.partial_candidates(staged).select("id"), "id", "left_anti").select("id", "size")


@query(FILES + "SELECT size, full_hash, member_count FROM groups")
def full_pipeline_groups(spark, d):  # noqa: ANN001, ANN201
    return pipeline.content_groups(corpus.plain_files(docs(spark, d)), N)


@query(FILES + "SELECT count(*) AS groups, CAST(coalesce(sum(member_count), 0) AS BIGINT) AS members, CAST(0 AS BIGINT) AS differing FROM groups")
def staged_equals_bruteforce(spark, d):  # noqa: ANN001, ANN201
    staged = pipeline.content_groups(corpus.plain_files(docs(spark, d)), N).withColumn("staged", F.lit(1))
    brute = groups.duplicate_groups(files(spark, d)).select("size", "full_hash", F.col("member_count").alias("expected"))
    both = brute.join(staged, ["size", "full_hash"], "full_outer")
    return both.agg(F.count("staged").alias("groups"), F.coalesce(F.sum("member_count"), F.lit(0)).alias("members"), F.count_if(~F.col("member_count").eqNullSafe(F.col("expected"))).alias("differing"))


@query(
    FILES
    + f"""SELECT CAST(coalesce(sum(least(size, {3 * N})), 0) AS BIGINT) AS sampled_bytes, count(*) AS sampled_files,
  (SELECT CAST(coalesce(sum(size), 0) AS BIGINT) FROM part_cand) AS full_bytes, (SELECT count(*) FROM part_cand) AS full_files,
  CAST(coalesce(sum(least(size, {3 * N})), 0) + (SELECT coalesce(sum(size), 0) FROM part_cand) AS BIGINT) AS bytes_hashed FROM size_cand"""
)
def bytes_hashed(spark, d):  # noqa: ANN001, ANN201
    return pipeline.bytes_hashed(corpus.plain_files(docs(spark, d)), N)


@query(FILES + "SELECT f.id, f.size, coalesce(c.partial_hash, '') AS partial_hash FROM files f LEFT JOIN size_cand c ON c.id = f.id")
def hash_persist(spark, d):  # noqa: ANN001, ANN201
    plain = corpus.plain_files(docs(spark, d))
    hashes = pipeline.size_stage(plain).select("id", hashing.partial_hash(F.col("text"), F.col("size"), N).alias("hash"))
    return diff.persist_hashes(plain.drop("text"), hashes, "partial_hash").select("id", "size", "partial_hash")


@query(f"SELECT doc_id AS id, sha256(text) AS full_hash, CAST(least(strlen(text), {3 * N}) AS BIGINT) AS sampled_bytes FROM documents")
def content_hashes(spark, d):  # noqa: ANN001, ANN201
    return docs(spark, d).select(F.col("doc_id").alias("id"), hashing.full_hash(F.col("text")).alias("full_hash"), hashing.sampled_bytes(F.octet_length("text").cast("bigint"), N).alias("sampled_bytes"))


@query(
    FILES
    + """, placed AS (SELECT id, size, id % 256 AS run, sum(size) OVER (ORDER BY id % 256, id ROWS UNBOUNDED PRECEDING) - size AS before, sum(size) OVER () AS total FROM files)
SELECT id, size, CAST(least(15, before * 16 // total) AS INTEGER) AS task FROM placed"""
)
def hash_tasks(spark, d):  # noqa: ANN001, ANN201
    """The task of each file when bytes are dealt out evenly over sixteen."""
    return hashing.deal_by_bytes(corpus.plain_files(docs(spark, d)).select("id", "size"), 16).select("id", "size", "task")


# ------------------------------------------------------------------ groups and browsing


@query(FILES + "SELECT size, full_hash, member_count, distinct_instance_count, reclaimable_bytes FROM groups")
def dup_groups(spark, d):  # noqa: ANN001, ANN201
    return found_groups(spark, d)


@query(FILES + "SELECT id, size, full_hash FROM members")
def dup_members(spark, d):  # noqa: ANN001, ANN201
    return groups.members(files(spark, d), found_groups(spark, d)).select("id", "size", "full_hash")


@query(FILES + "SELECT id, size, full_hash, count(*) OVER (PARTITION BY size, full_hash, device, inode) > 1 AS shares_inode FROM members")
def hardlink_flag(spark, d):  # noqa: ANN001, ANN201
    return groups.with_shared_inode(groups.members(files(spark, d), found_groups(spark, d))).select("id", "size", "full_hash", "shares_inode")


@query(
    FILES
    + """SELECT id, root_id, root_path, rel_path, size, full_hash, device, inode, count(*) OVER (PARTITION BY device, inode) > 1 AS shares_inode
FROM members WHERE (size, full_hash) = (SELECT (size, full_hash) FROM groups ORDER BY reclaimable_bytes DESC, size DESC, full_hash LIMIT 1)"""
)
def group_detail(spark, d):  # noqa: ANN001, ANN201
    all_files = files(spark, d).drop("root_path")
    found = groups.duplicate_groups(all_files)
    top = browse.ordered(found).select("size", "full_hash").first()
    return browse.detail(all_files, found, corpus.roots(docs(spark, d)), *(top or (0, "")))


def _paged(by: browse.DuplicateFilter) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, d: str) -> DataFrame:
        all_files = files(spark, d)
        return browse.page(groups.duplicate_groups(all_files), all_files, by)

    return run


def _filtered(by: browse.DuplicateFilter) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, d: str) -> DataFrame:
        all_files = files(spark, d)
        return browse.filtered(groups.duplicate_groups(all_files), all_files, by)

    return run


GROUP_COLUMNS = "SELECT size, full_hash, member_count, distinct_instance_count, reclaimable_bytes FROM groups g"
SOME_MEMBER = "EXISTS (SELECT 1 FROM members m WHERE m.size = g.size AND m.full_hash = g.full_hash AND {})"
ASCII_LOWER = "translate(rel_path, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

for _name, _run, _sql in (
    ("groups_page", _paged(browse.DuplicateFilter(page=2, page_size=10)), GROUP_COLUMNS + " ORDER BY reclaimable_bytes DESC, size DESC, full_hash LIMIT 10 OFFSET 10"),
    ("groups_filter_root", _filtered(browse.DuplicateFilter(root_id=3)), f"{GROUP_COLUMNS} WHERE {SOME_MEMBER.format('root_id = 3')}"),
    ("groups_filter_name", _filtered(browse.DuplicateFilter(name_like="N/%5_.TXT")), f"{GROUP_COLUMNS} WHERE {SOME_MEMBER.format(ASCII_LOWER + chr(32) + 'LIKE ' + repr('%n/%5_.txt%'))}"),
    ("groups_filter_minsize", _filtered(browse.DuplicateFilter(min_size=1500)), GROUP_COLUMNS + " WHERE size >= 1500"),
    ("groups_filter_parsed", _filtered(browse.DuplicateFilter.parse(root_id=" 2 ", min_size="200", name_like="De/", page="x", page_size="-3")), f"{GROUP_COLUMNS} WHERE size >= 200 AND {SOME_MEMBER.format('root_id = 2 AND ' + ASCII_LOWER + ' LIKE ' + repr('%de/%'))}"),
    ("groups_filter_combined", _filtered(browse.DuplicateFilter(root_id=3, min_size=300, name_like="EN/")), f"{GROUP_COLUMNS} WHERE size >= 300 AND {SOME_MEMBER.format('root_id = 3 AND ' + ASCII_LOWER + ' LIKE ' + repr('%en/%'))}"),
):
    QUERIES[_name], ORACLE_SQL[_name] = _run, FILES + _sql


@query(FILES + f"SELECT count(*) AS total, greatest(1, CAST(ceil(count(*) / 10) AS BIGINT)) AS pages FROM groups g WHERE {SOME_MEMBER.format('root_id = 3')}")
def filtered_count(spark, d):  # noqa: ANN001, ANN201
    all_files = files(spark, d)
    return browse.page_info(groups.duplicate_groups(all_files), all_files, browse.DuplicateFilter(root_id=3, page_size=10))


@query(FILES + "SELECT count(*) AS total_files, CAST(coalesce(sum(size), 0) AS BIGINT) AS total_bytes FROM files WHERE status = 'present'")
def summary_files(spark, d):  # noqa: ANN001, ANN201
    return browse.summary_files(corpus.plain_files(docs(spark, d)))


@query(FILES + "SELECT count(*) AS duplicate_groups, CAST(coalesce(sum(reclaimable_bytes), 0) AS BIGINT) AS reclaimable_bytes FROM groups")
def summary_groups(spark, d):  # noqa: ANN001, ANN201
    return browse.summary_groups(found_groups(spark, d))


@query(FILES + "SELECT size, full_hash, member_count, distinct_instance_count, reclaimable_bytes, root_count FROM groups JOIN (SELECT size, full_hash, count(DISTINCT root_id) AS root_count FROM members GROUP BY ALL) USING (size, full_hash) WHERE root_count > 1")
def cross_root_groups(spark, d):  # noqa: ANN001, ANN201
    all_files = files(spark, d)
    return groups.cross_root(all_files, groups.duplicate_groups(all_files))


@query(FILES + "SELECT size, full_hash, member_count FROM groups WHERE reclaimable_bytes = 0")
def zero_reclaimable_groups(spark, d):  # noqa: ANN001, ANN201
    return found_groups(spark, d).where("reclaimable_bytes = 0").select("size", "full_hash", "member_count")


@query(FILES + "SELECT size, full_hash, CASE WHEN distinct_instance_count = member_count THEN CAST(member_count AS VARCHAR) ELSE distinct_instance_count || ' (' || member_count || ' paths)' END AS copies FROM groups")
def copies_label(spark, d):  # noqa: ANN001, ANN201
    return found_groups(spark, d).select("size", "full_hash", formatting.copies_label(F.col("distinct_instance_count"), F.col("member_count")).alias("copies"))


@query(FILES + "SELECT id, size FROM usable WHERE id > 100 ORDER BY id LIMIT 50")
def keyset_page(spark, d):  # noqa: ANN001, ANN201
    return candidates.present(corpus.plain_files(docs(spark, d))).where("id > 100").orderBy("id").limit(50).select("id", "size")


@query(FILES + f"SELECT id, rel_path FROM files WHERE {ASCII_LOWER} LIKE '%e_/1%'")
def name_match(spark, d):  # noqa: ANN001, ANN201
    return files(spark, d).where(matching.contains_like(F.col("rel_path"), "E_/1")).select("id", "rel_path")


@query(FILES + "SELECT id, CASE WHEN ends_with(root_path, '/') THEN root_path ELSE root_path || '/' END || rel_path AS abs_path FROM files")
def absolute_path(spark, d):  # noqa: ANN001, ANN201
    return files(spark, d).select("id", paths.absolute(F.col("root_path"), F.col("rel_path")).alias("abs_path"))


@query(FILES + "SELECT id, CASE WHEN id % 3 = 0 THEN NULL ELSE rel_path END AS rel_path FROM files")
def relative_path(spark, d):  # noqa: ANN001, ANN201
    """Every third root has another name that begins alike, so that its files aren't below it."""
    root = F.when(F.col("id") % 3 == 0, F.concat("root_path", F.lit("x"))).otherwise(F.concat("root_path", F.lit("/")))
    return files(spark, d).select("id", paths.relative(root, paths.absolute(F.col("root_path"), F.col("rel_path"))).alias("rel_path"))


@query(
    """WITH e AS (SELECT l_orderkey * 10 + l_linenumber AS id, CASE WHEN l_orderkey % 7 = 0 THEN NULL ELSE (l_orderkey % 16) * 4096 + l_partkey % 512 END AS mode FROM lineitem)
SELECT id, CASE WHEN mode IS NULL THEN 'unreadable' ELSE CASE mode & 61440 WHEN 32768 THEN 'file' WHEN 16384 THEN 'directory' WHEN 40960 THEN 'link' WHEN 4096 THEN 'pipe' WHEN 49152 THEN 'socket'
  WHEN 8192 THEN 'character device' WHEN 24576 THEN 'block device' ELSE 'unknown' END END AS kind FROM e"""
)
def entry_kinds(spark, d):  # noqa: ANN001, ANN201
    """What entries are by their modes, as the walk decides."""
    mode = F.when(F.col("l_orderkey") % 7 != 0, (F.col("l_orderkey") % 16) * 4096 + F.col("l_partkey") % 512)
    return spark.read.parquet(f"{d}/lineitem.parquet").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), entries.kind(mode).alias("kind"))


@query(
    """WITH e AS (SELECT 1000000 + l_orderkey * 10 + l_linenumber AS id, l_suppkey AS size, CASE WHEN l_orderkey % 7 = 0 THEN NULL ELSE (l_orderkey % 16) * 4096 END AS mode FROM lineitem)
SELECT count(*) AS met, count(*) FILTER (mode & 61440 = 32768) AS files, CAST(sum(size) FILTER (mode & 61440 = 32768) AS BIGINT) AS bytes, count(*) FILTER ((mode & 61440 = 32768) IS NOT TRUE) AS skipped FROM e"""
)
def walk_regular_files(spark, d):  # noqa: ANN001, ANN201
    """Only regular files come through a walk; the others are skipped and have no stat."""
    mode = F.when(F.col("l_orderkey") % 7 != 0, (F.col("l_orderkey") % 16) * 4096)
    met = spark.read.parquet(f"{d}/lineitem.parquet").select(F.lit(1).alias("root_id"), F.lit("/").alias("abs_path"), F.lit("x").alias("rel_path"), F.col("l_suppkey").cast("long").alias("size"), *(F.lit(1).alias(c) for c in ("mtime_ns", "device", "inode")), mode.alias("mode"))
    return entries.as_walk(met).agg(F.count("*").alias("met"), F.count_if(~F.col("skipped")).alias("files"), F.sum("size").alias("bytes"), F.count_if("skipped").alias("skipped"))


_ENTERED = "SELECT doc_id AS id, CASE WHEN doc_id % 5 = 0 THEN chr(9) || ' ' ELSE ' /data/' || source || CASE WHEN doc_id % 3 = 0 THEN '/' ELSE '' END || chr(10) END AS path, CASE doc_id % 4 WHEN 0 THEN NULL WHEN 1 THEN '  ' ELSE ' ' || lang || ' ' END AS label FROM documents"


@query(
    f"""WITH given AS ({_ENTERED}), cut AS (SELECT trim(path, ' ' || chr(9) || chr(10)) AS path, trim(coalesce(label, ''), ' ') AS label FROM given)
SELECT path, CASE WHEN label <> '' THEN label WHEN ends_with(path, '/') THEN path ELSE split_part(path, '/', -1) END AS label, count(*) AS n FROM cut WHERE path <> '' GROUP BY 1, 2"""
)
def roots_entered(spark, d):  # noqa: ANN001, ANN201
    """Roots as they are typed in: trimmed, named, those without a path left out."""
    i = F.col("doc_id")
    path = F.when(i % 5 == 0, "\t ").otherwise(F.concat(F.lit(" /data/"), "source", F.when(i % 3 == 0, "/").otherwise(""), F.lit("\n")))
    label = F.when(i % 4 == 1, "  ").when(i % 4 > 1, F.concat(F.lit(" "), "lang", F.lit(" ")))
    return lifecycle.cleaned(docs(spark, d).select(path.alias("path"), label.alias("label"))).groupBy("path", "label").agg(F.count("*").alias("n"))


@query(FILES + "SELECT id, path FROM roots WHERE path NOT IN (SELECT root_path FROM files WHERE id % 40 = 0)")
def roots_absent(spark, d):  # noqa: ANN001, ANN201
    """Roots that a listing of directories doesn't have."""
    there = files(spark, d).where("id % 40 = 0").select(F.col("root_path").alias("path")).distinct()
    return lifecycle.absent(corpus.roots(docs(spark, d)), there).select("id", "path")


@query(FILES + "SELECT root_id, split_part(rel_path, '/', 1) AS directory, count(*) AS files FROM files WHERE contains(rel_path, '/') GROUP BY 1, 2")
def top_directories(spark, d):  # noqa: ANN001, ANN201
    """Immediate sub-directories of the roots, with the files below each."""
    top = paths.top_directory(F.col("rel_path"))
    return files(spark, d).select("root_id", top.alias("directory")).where("directory IS NOT NULL").groupBy("root_id", "directory").agg(F.count("*").alias("files"))


# ------------------------------------------------------------------ snapshots


@query(FILES + "SELECT root_id, rel_path, size, mtime_ns, change_type FROM classified")
def diff_classify(spark, d):  # noqa: ANN001, ANN201
    return classified(spark, d).select("root_id", "rel_path", "size", "mtime_ns", "change_type")


def _of_kind(kind: str) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, d: classified(spark, d).where(F.col("change_type") == kind).select("root_id", "rel_path", "size")


for _kind in ("new", "changed", "missing", "reappeared"):
    QUERIES[f"diff_{_kind}"], ORACLE_SQL[f"diff_{_kind}"] = _of_kind(_kind), FILES + f"SELECT root_id, rel_path, size FROM classified WHERE change_type = '{_kind}'"


@query(
    FILES
    + """SELECT count(*) FILTER (change_type IN ('new', 'changed', 'reappeared', 'unchanged')) AS files_seen, count(*) FILTER (change_type = 'new') AS files_new,
  count(*) FILTER (change_type = 'changed') AS files_changed, count(*) FILTER (change_type = 'missing') AS files_removed, CAST(0 AS BIGINT) AS files_skipped FROM classified"""
)
def scan_counters(spark, d):  # noqa: ANN001, ANN201
    return diff.counters(classified(spark, d))


@query(
    FILES
    + """SELECT root_id, rel_path, size, mtime_ns, CASE WHEN change_type IN ('new', 'changed') THEN '' ELSE old_hash END AS full_hash,
  CAST(CASE WHEN change_type IN ('new', 'changed', 'reappeared') THEN 2 ELSE 1 END AS BIGINT) AS last_seen_scan_id,
  CASE WHEN change_type IN ('missing', 'gone') THEN 'missing' ELSE 'present' END AS status FROM classified"""
)
def merge_snapshot(spark, d):  # noqa: ANN001, ANN201
    return diff.merged(classified(spark, d), 2, F.lit(1)).select("root_id", "rel_path", "size", "mtime_ns", "full_hash", "last_seen_scan_id", "status")


@query(
    FILES
    + """SELECT id + 1000000000 AS id, root_id, size, status FROM files WHERE id % 9 = 0 UNION ALL
SELECT id, root_id, CASE WHEN id % 35 = 0 THEN size + 3 WHEN id % 5 = 0 THEN size + 1 ELSE size END AS size,
  CASE WHEN id % 35 = 0 THEN 'present' WHEN id % 7 = 0 THEN 'missing' ELSE status END AS status FROM files"""
)
def delta_snapshot(spark, d):  # noqa: ANN001, ANN201
    """A base and three changes: sizes, then marks of missing files, then files that are new or were touched by both."""
    base = files(spark, d).select("id", "root_id", "size", "status")
    first = base.where("id % 5 = 0").withColumn("size", F.col("size") + 1)
    second = base.where("id % 7 = 0").withColumn("status", F.lit("missing"))
    third = base.where("id % 35 = 0").select("id", "root_id", (F.col("size") + 3).alias("size"), F.lit("present").alias("status"))
    third = third.unionByName(base.where("id % 9 = 0").withColumn("id", F.col("id") + 1000000000))
    return deltas.Newest(("id",)).read(base, [first, second, third])


@query(FILES + "SELECT id, root_id, rel_path, size, mtime_ns, 'present' AS status, CAST(NULL AS BIGINT) AS last_seen_scan_id FROM files")
def migrated_files(spark, d):  # noqa: ANN001, ANN201
    """Files of an earlier shape (int sizes, another name of a column, one that is gone, two that are missing) as those of now."""
    old = files(spark, d).select(F.col("id").cast("int").alias("id"), "root_id", F.col("rel_path").alias("path_below"), F.col("size").cast("int").alias("size"), "mtime_ns", F.lit("x").alias("note"))
    wanted = T.StructType([*(T.StructField(c, T.LongType()) for c in ("id", "root_id")), T.StructField("rel_path", T.StringType()), *(T.StructField(c, T.LongType()) for c in ("size", "mtime_ns")), T.StructField("status", T.StringType()), T.StructField("last_seen_scan_id", T.LongType())])
    return migrate.apply(old, migrate.plan(old.schema, wanted, {"status": "present"}, {"rel_path": "path_below"}))


def _changed_files(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """An earlier state of the files, and the rows in which the current one differs, with ``was``."""
    now = files(spark, d).select("id", "status", *regroup.INSTANCE)
    before = now.select("id", F.when(F.col("id") % 13 == 0, "missing").otherwise(F.col("status")).alias("status"), (F.col("size") + F.when(F.col("id") % 7 == 0, 1).otherwise(0)).alias("size"), F.when(F.col("id") % 11 == 0, "").otherwise(F.col("full_hash")).alias("full_hash"), "device", "inode")
    both = now.join(before.select("id", F.struct(*before.columns).alias("was")), "id")
    return before, both.where(~F.struct(*now.columns).eqNullSafe(F.col("was")))


@query(FILES + "SELECT size, full_hash, member_count, distinct_instance_count, reclaimable_bytes FROM groups")
def regroup_incremental(spark, d):  # noqa: ANN001, ANN201
    """Groups of an earlier state, kept up from the rows that changed: equals grouping all files anew."""
    before, changed = _changed_files(spark, d)
    held, moved = regroup.instances(before).drop("part"), regroup.contributions(changed).drop("part")
    old = regroup.groups_of(held)
    now = deltas.Summed(tuple(regroup.INSTANCE), "paths").read(held, [moved])
    new = regroup.regrouped(now, moved.select(*groups.KEY).distinct(), old).drop("part")
    return deltas.Newest(tuple(groups.KEY), dead="member_count < 2").read(old, [new])


@query(
    FILES
    + """, before AS (
  SELECT id, CASE WHEN id % 13 = 0 THEN 'missing' ELSE status END AS status, size + CASE WHEN id % 7 = 0 THEN 1 ELSE 0 END AS size, CASE WHEN id % 11 = 0 THEN '' ELSE full_hash END AS full_hash, device, inode FROM files
), sides AS (
  SELECT size, full_hash, device, inode, 1 AS n FROM usable UNION ALL SELECT size, full_hash, device, inode, -1 FROM before WHERE status = 'present' AND size > 0 AND full_hash <> ''
)
SELECT size, full_hash, device, inode, CAST(sum(n) AS BIGINT) AS paths FROM sides GROUP BY ALL HAVING sum(n) <> 0"""
)
def instance_changes(spark, d):  # noqa: ANN001, ANN201
    """What a change of files means for the paths of each instance."""
    return regroup.contributions(_changed_files(spark, d)[1]).drop("part")


RESCAN = (
    FILES
    + """, top AS (SELECT size, full_hash FROM groups ORDER BY member_count DESC, size DESC, full_hash LIMIT 1
), patched AS (
  SELECT u.* REPLACE (CASE WHEN (u.size, u.full_hash) = (t.size, t.full_hash) AND u.id % 3 = 1 THEN 'changed' ELSE u.full_hash END AS full_hash)
  FROM usable u, top t WHERE NOT ((u.size, u.full_hash) = (t.size, t.full_hash) AND u.id % 3 = 0)
)
SELECT size, full_hash, count(*) AS member_count, count(DISTINCT device || '/' || inode) AS distinct_instance_count, (count(DISTINCT device || '/' || inode) - 1) * size AS reclaimable_bytes
FROM patched WHERE full_hash <> 'changed' GROUP BY size, full_hash HAVING count(*) > 1"""
)


def _rechecked(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame, tuple]:
    """Files before and after, groups before, and the key of a recheck of the largest group, where thirds of the ids are missing or have another hash."""
    all_files = files(spark, d).drop("root_path").withColumn("updated_at", F.lit(1).cast("bigint"))
    found = groups.duplicate_groups(all_files)
    top = found.orderBy(F.desc("member_count"), F.desc("size"), "full_hash").select("size", "full_hash").first() or (0, "")
    mine = groups.members(all_files, found).where((F.col("size") == top[0]) & (F.col("full_hash") == top[1]))
    outcome = F.when(F.col("id") % 3 == 0, "missing").when(F.col("id") % 3 == 1, "changed").otherwise("unchanged")
    outcomes = mine.select("id", outcome.alias("outcome"), *diff.STAT, F.when(F.col("id") % 3 == 1, "changed").otherwise(F.col("full_hash")).alias("full_hash"))
    return all_files, rescan.patched(all_files, outcomes, F.lit(2).cast("bigint")), found, tuple(top)


@query(RESCAN)
def group_rescan_patch(spark, d):  # noqa: ANN001, ANN201
    _, after, found, top = _rechecked(spark, d)
    return rescan.repaired_groups(found, after, *top)


@query(
    FILES
    + """, top AS (SELECT size, full_hash FROM groups ORDER BY member_count DESC, size DESC, full_hash LIMIT 1
), marked AS (SELECT f.*, coalesce(f.status = 'present' AND (f.size, f.full_hash) = (t.size, t.full_hash), false) AS mine FROM files f LEFT JOIN top t ON true)
SELECT id, CASE WHEN mine AND id % 3 = 0 THEN 'missing' ELSE status END AS status, CASE WHEN mine AND id % 3 = 1 THEN 'changed' ELSE full_hash END AS full_hash,
  CASE WHEN mine AND id % 3 = 1 THEN '' ELSE partial_hash END AS partial_hash, CAST(CASE WHEN mine AND id % 3 < 2 THEN 2 ELSE 1 END AS BIGINT) AS updated_at FROM marked"""
)
def group_rescan_files(spark, d):  # noqa: ANN001, ANN201
    return _rechecked(spark, d)[1].select("id", "status", "full_hash", "partial_hash", "updated_at")


@query(FILES + "SELECT count(*) AS checked, count(*) FILTER (id % 5 = 0) AS missing, count(*) FILTER (id % 5 = 1) AS changed, count(*) FILTER (id % 5 = 2) AS errors, count(*) FILTER (id % 5 > 2) AS unchanged FROM members")
def rescan_outcomes(spark, d):  # noqa: ANN001, ANN201
    outcome = F.element_at(F.array(*map(F.lit, ("missing", "changed", "error", "unchanged", "unchanged"))), (F.col("id") % 5 + 1).cast("int"))
    return rescan.outcome_counts(groups.members(files(spark, d), found_groups(spark, d)).select(outcome.alias("outcome")))


# ------------------------------------------------------------------ roots and scans


@query(FILES + "SELECT size, full_hash, count(*) AS member_count, count(DISTINCT device || '/' || inode) AS distinct_instance_count, (count(DISTINCT device || '/' || inode) - 1) * size AS reclaimable_bytes FROM usable WHERE root_id <> 3 GROUP BY size, full_hash HAVING count(*) > 1")
def root_delete_regroup(spark, d):  # noqa: ANN001, ANN201
    return groups.duplicate_groups(lifecycle.without_root(files(spark, d), 3))


@query("SELECT DISTINCT '/scan/' || source AS path FROM documents WHERE CAST(substr(source, 4) AS BIGINT) % 2 = 1")
def root_discover(spark, d):  # noqa: ANN001, ANN201
    found = corpus.roots(docs(spark, d))
    return lifecycle.undiscovered(found.select("path"), found.where("id % 2 = 0"))


@query(FILES + "SELECT id, path, label, enabled FROM roots WHERE enabled")
def enabled_targets(spark, d):  # noqa: ANN001, ANN201
    return lifecycle.enabled_targets(corpus.roots(docs(spark, d)))


@query(FILES + "SELECT id, path, CASE WHEN id = 4 THEN NOT enabled ELSE enabled END AS enabled, 'manual' AS source FROM roots")
def root_toggle_migrate(spark, d):  # noqa: ANN001, ANN201
    return lifecycle.migrated_roots(lifecycle.toggled(corpus.roots(docs(spark, d)), 4)).select("id", "path", "enabled", "source")


@query(SCANS + "SELECT id, started_at, status FROM scans ORDER BY started_at DESC, id DESC LIMIT 50")
def scan_history(spark, d):  # noqa: ANN001, ANN201
    return lifecycle.history(scans(spark, d)).select("id", F.col("started_at").cast("timestamp_ntz").alias("started_at"), "status")


@query(SCANS + "SELECT id, status FROM scans WHERE status = 'running' ORDER BY started_at DESC, id DESC LIMIT 1")
def current_scan(spark, d):  # noqa: ANN001, ANN201
    return lifecycle.current(scans(spark, d)).select("id", "status")


@query(SCANS + "SELECT CASE status WHEN 'running' THEN 'interrupted' ELSE status END AS status, count(*) AS n, count(coalesce(finished_at, TIMESTAMP '2030-01-01')) AS finished FROM scans GROUP BY 1")
def interrupted_scans(spark, d):  # noqa: ANN001, ANN201
    return lifecycle.interrupted(scans(spark, d), F.lit("2030-01-01").cast("timestamp")).groupBy("status").agg(F.count("*").alias("n"), F.count("finished_at").alias("finished"))


@query(SCANS + "SELECT id AS scan_id, CASE status WHEN 'completed' THEN 'scan_completed' ELSE 'scan_failed' END AS type, CAST(epoch_ms(finished_at) - epoch_ms(started_at) AS BIGINT) AS elapsed_ms FROM scans WHERE finished_at IS NOT NULL")
def terminal_events(spark, d):  # noqa: ANN001, ANN201
    return progress.terminal_events(full_scans(spark, d)).select("scan_id", "type", "elapsed_ms")


def full_scans(spark: SparkSession, d: str) -> DataFrame:
    """The scans with a phase, no error, zero counters and two roots each."""
    roots = F.array(F.col("id") % 4 + 1, F.col("id") % 3 + 5).alias("root_ids")
    return scans(spark, d).select("*", F.lit("finalizing").alias("phase"), F.lit("").alias("error"), *(F.lit(0).cast("bigint").alias(c) for c in progress.COUNTERS), roots)


@query(FILES.replace("WITH base", "WITH links AS (SELECT o_orderkey AS scan_id, unnest([o_orderkey % 4 + 1, o_orderkey % 3 + 5]) AS root_id FROM orders), base") + "SELECT scan_id, root_id, path FROM links JOIN roots ON roots.id = root_id")
def scan_roots(spark, d):  # noqa: ANN001, ANN201
    return lifecycle.scan_roots(full_scans(spark, d), corpus.roots(docs(spark, d)))


@query(SCANS + "SELECT id, CASE id WHEN 7 THEN 'hashing' ELSE 'finalizing' END AS phase, CAST(CASE id WHEN 7 THEN 12 ELSE 0 END AS BIGINT) AS files_seen, CAST(CASE id WHEN 7 THEN 3 ELSE 0 END AS BIGINT) AS files_new, CAST(0 AS BIGINT) AS bytes_hashed FROM scans")
def scan_counters_overwrite(spark, d):  # noqa: ANN001, ANN201
    return lifecycle.with_counters(full_scans(spark, d), 7, "hashing", {"files_seen": 12, "files_new": 3}).select("id", "phase", "files_seen", "files_new", "bytes_hashed")


@query(SCANS + "SELECT id, status FROM scans WHERE id = 7")
def scan_by_id(spark, d):  # noqa: ANN001, ANN201
    return lifecycle.by_id(scans(spark, d), 7).select("id", "status")


@query(FILES + "SELECT id, path, TIMESTAMP '2024-01-01' + to_days(CAST(id * 7 % 5 AS INTEGER)) AS added_at FROM roots ORDER BY added_at, id")
def roots_by_added(spark, d):  # noqa: ANN001, ANN201
    added = F.timestamp_add("DAY", (F.col("id") * 7 % 5).cast("int"), F.lit("2024-01-01").cast("timestamp_ntz"))
    return lifecycle.by_added(corpus.roots(docs(spark, d)).withColumn("added_at", added)).select("id", "path", "added_at")


@query(
    SCANS
    + """, log AS (
  SELECT CASE WHEN event_id % 50 = 0 THEN 'scan_completed' ELSE event_type END AS type, user_id AS scan_id, CASE WHEN event_id % 3 = 0 THEN '' ELSE 'walking' END AS phase, event_id AS elapsed_ms FROM events
)
SELECT type, scan_id, phase, elapsed_ms FROM log UNION ALL
SELECT CASE status WHEN 'completed' THEN 'scan_completed' ELSE 'scan_failed' END, id, 'finalizing', CAST(epoch_ms(finished_at) - epoch_ms(started_at) AS BIGINT)
FROM scans WHERE finished_at IS NOT NULL AND id NOT IN (SELECT scan_id FROM log WHERE type = 'scan_completed')"""
)
def events_with_terminal(spark, d):  # noqa: ANN001, ANN201
    log = events(spark, d).withColumn("type", F.when(F.col("elapsed_ms") % 50 == 0, "scan_completed").otherwise(F.col("type")))
    return progress.with_terminal(log, full_scans(spark, d))


# ------------------------------------------------------------------ progress and formats


def events(spark: SparkSession, d: str) -> DataFrame:
    """The event table as a progress log: users are scans, event ids run with time."""
    e = spark.read.parquet(f"{d}/events.parquet")
    return e.select(F.col("event_type").alias("type"), F.col("user_id").alias("scan_id"), F.when(F.col("event_id") % 3 == 0, "").otherwise("walking").alias("phase"), F.col("event_id").alias("elapsed_ms"))


@query("SELECT user_id AS scan_id, arg_max(event_type, event_id) AS type, max(event_id) AS elapsed_ms FROM events GROUP BY 1")
def latest_progress(spark, d):  # noqa: ANN001, ANN201
    return progress.latest(events(spark, d)).select("scan_id", "type", "elapsed_ms")


@query("""SELECT event_id, '{"type":"' || event_type || '","scan_id":' || user_id || CASE WHEN event_id % 3 = 0 THEN '' ELSE ',"phase":"walking"' END || ',"elapsed_ms":' || event_id || '}' AS json FROM events""")
def progress_json(spark, d):  # noqa: ANN001, ANN201
    e = events(spark, d)
    return e.select(F.col("elapsed_ms").alias("event_id"), progress.event_json(e, ("phase",)).alias("json"))


@query("SELECT event_id, event_type AS type FROM events WHERE user_id = 7")
def events_of_scan(spark, d):  # noqa: ANN001, ANN201
    return progress.of_scan(events(spark, d), 7).select(F.col("elapsed_ms").alias("event_id"), "type")


@query("SELECT event_id, CASE event_id % 4 WHEN 0 THEN 25 WHEN 1 THEN 65 WHEN 2 THEN 95 ELSE 0 END AS percent FROM events")
def progress_percent(spark, d):  # noqa: ANN001, ANN201
    phase = F.element_at(F.array(*map(F.lit, ("walking", "hashing", "finalizing", ""))), (F.col("event_id") % 4 + 1).cast("int"))
    return spark.read.parquet(f"{d}/events.parquet").select("event_id", formatting.progress_percent(phase).alias("percent"))


BYTES_SQL = "CASE " + " ".join(f"WHEN b >= {1 << 10 * k} THEN printf('%.1f {u}B', b::DOUBLE / {1 << 10 * k})" for k, u in reversed(list(enumerate(formatting.UNITS, 1)))) + " ELSE b || ' B' END"


@query(f"SELECT id, {BYTES_SQL} AS size_text FROM (SELECT l_orderkey * 10 + l_linenumber AS id, CAST(l_orderkey * l_orderkey * l_partkey * (l_linenumber * l_linenumber - 3) AS BIGINT) AS v FROM lineitem) t, LATERAL (SELECT abs(v) AS b)")
def format_bytes(spark, d):  # noqa: ANN001, ANN201
    items = spark.read.parquet(f"{d}/lineitem.parquet")
    line = F.col("l_linenumber").cast("bigint")
    size = lambda order: F.abs(order * order * F.col("l_partkey") * (line * line - 3))
    fits = size(F.col("l_orderkey").cast("double")) < float(1 << 62)  # beyond 64 bits from some millions of orders
    text = F.when(fits, formatting.format_bytes(size(F.col("l_orderkey").cast("bigint")))).otherwise(formatting.format_bytes(size(F.col("l_orderkey").cast("decimal(38,0)"))))
    return items.select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), text.alias("size_text"))


@query(FILES + "SELECT id, substr(full_hash, 1, 12) AS short_hash FROM files")
def short_hash(spark, d):  # noqa: ANN001, ANN201
    return files(spark, d).select("id", formatting.short_hash(F.col("full_hash")).alias("short_hash"))


@query(
    """WITH t AS (SELECT o_orderkey AS id, greatest(0, (o_orderkey * o_custkey * 7 - 500 + 500) // 1000) AS s FROM orders)
SELECT id, CASE WHEN s >= 86400 THEN (s // 86400) || 'd ' || (s // 3600 % 24) || 'h ' || (s // 60 % 60) || 'm ' || (s % 60) || 's' WHEN s >= 3600 THEN (s // 3600) || 'h ' || (s // 60 % 60) || 'm ' || (s % 60) || 's'
  WHEN s >= 60 THEN (s // 60) || 'm ' || (s % 60) || 's' ELSE s || 's' END AS duration FROM t"""
)
def format_duration(spark, d):  # noqa: ANN001, ANN201
    o = spark.read.parquet(f"{d}/orders.parquet")
    return o.select(F.col("o_orderkey").alias("id"), formatting.format_duration_ms(F.col("o_orderkey") * F.col("o_custkey") * 7 - 500).alias("duration"))


@query("SELECT o_orderkey AS id, CASE WHEN o_orderkey % 5 = 0 THEN '-' ELSE strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') END AS at FROM orders")
def format_time(spark, d):  # noqa: ANN001, ANN201
    o = spark.read.parquet(f"{d}/orders.parquet")
    return o.select(F.col("o_orderkey").alias("id"), formatting.format_time(F.when(F.col("o_orderkey") % 5 != 0, F.col("o_orderdate").cast("timestamp_ntz"))).alias("at"))


TAGS = """CASE p_partkey % 6 WHEN 0 THEN 'v2026.' || (p_partkey % 12 + 1) || '.' || (p_partkey % 28) WHEN 1 THEN '2026.' || (p_partkey % 7) || '.3.1' WHEN 2 THEN 'dev'
  WHEN 3 THEN ' v2026.5' WHEN 4 THEN 'v2026.5.0' ELSE 'v2026..1' END"""


@query(f"SELECT id, tag FROM (SELECT p_partkey AS id, {TAGS} AS tag FROM part) WHERE len(list_filter(string_split(regexp_replace(trim(tag), '^v', ''), '.'), lambda x: NOT regexp_full_match(x, '[+-]?[0-9]{{1,18}}'))) = 0")
def release_tags(spark, d):  # noqa: ANN001, ANN201
    tags = spark.read.parquet(f"{d}/part.parquet").select(F.col("p_partkey").alias("id"), F.expr(TAGS).alias("tag"))
    return tags.where(versioning.is_release(F.col("tag")))


PARSED = "CASE WHEN len(list_filter({p}, lambda x: NOT regexp_full_match(x, '[+-]?[0-9]{{1,18}}'))) = 0 THEN list_transform({p}, lambda x: CAST(x AS BIGINT)) ELSE CAST([] AS BIGINT[]) END"


@query(
    f"""WITH t AS (SELECT p_partkey AS id, {TAGS} AS candidate, {TAGS.replace("p_partkey", "(p_partkey // 6)")} AS current FROM part
), s AS (SELECT *, string_split(regexp_replace(trim(candidate), '^v', ''), '.') AS ca, string_split(regexp_replace(trim(current), '^v', ''), '.') AS cb FROM t
), n AS (SELECT *, {PARSED.format(p="ca")} AS a, {PARSED.format(p="cb")} AS b FROM s)
SELECT id, candidate, current, len(a) > 0 AS is_release, len(a) > 0 AND len(b) > 0 AND list_resize(a, greatest(len(a), len(b)), 0) > list_resize(b, greatest(len(a), len(b)), 0) AS newer FROM n"""
)
def version_newer(spark, d):  # noqa: ANN001, ANN201
    def tag(k: str) -> Column:
        return F.expr(TAGS.replace("p_partkey", k))

    t = spark.read.parquet(f"{d}/part.parquet").select(F.col("p_partkey").alias("id"), tag("p_partkey").alias("candidate"), tag("(p_partkey div 6)").alias("current"))
    return t.select("*", versioning.is_release(F.col("candidate")).alias("is_release"), versioning.newer(F.col("candidate"), F.col("current")).alias("newer"))
