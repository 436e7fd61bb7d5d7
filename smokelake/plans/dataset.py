"""Queries on labelled image sets."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators import dataset as O
from ..operators.shared import materialize, shared_folder
from .registry import query


MEDIA = "regexp_extract(path, '^(.*/)([^/]*)_([VP])\\.([^/]+)$', {})"


@query("a04_pair_media", f"""WITH f AS (SELECT path, {MEDIA.format(1)} AS folder, {MEDIA.format(2)} AS stem, {MEDIA.format(3)} AS kind, {MEDIA.format(4)} AS e FROM media),
r AS (SELECT *, CASE kind WHEN 'V' THEN coalesce(list_position(['MP4', 'mp4', 'MOV', 'mov', 'AVI', 'avi'], e), 9) ELSE list_position(['JPG', 'jpg', 'JPEG', 'jpeg', 'PNG', 'png'], e) END AS n FROM f),
b AS (SELECT folder, stem, kind, path FROM r x WHERE n IS NOT NULL AND NOT EXISTS (SELECT 1 FROM r y WHERE y.folder = x.folder AND y.stem = x.stem AND y.kind = x.kind AND (y.n < x.n OR (y.n = x.n AND y.path < x.path))))
SELECT v.folder, v.stem, v.path AS video, p.path AS image FROM b v JOIN b p ON v.folder = p.folder AND v.stem = p.stem WHERE v.kind = 'V' AND p.kind = 'P'""")
def a04(t):
    """Cards that hold files of the same stem, and stems whose two files lie in different folders."""
    return O.pair_media(t("media"))


LABELS = """tok AS (SELECT image_id, line_no, string_split_regex(trim(line), '\\s+') AS t FROM yolo_lines WHERE trim(line) <> ''),
val AS (SELECT image_id, line_no, len(t) AS n, TRY_CAST(t[1] AS INT) AS class_id, list_transform(t[2:], lambda x: TRY_CAST(x AS DOUBLE)) AS v FROM tok),
lab AS (SELECT image_id, line_no, n, class_id, v, CASE WHEN n <> 5 AND (n < 7 OR n % 2 = 0) THEN 'token_count' WHEN class_id IS NULL OR class_id NOT IN (0, 1, 2) THEN 'unknown_class'
 WHEN len(list_filter(v, lambda x: x IS NULL)) > 0 THEN 'not_a_number' WHEN list_min(v) < -0.001 OR list_max(v) > 1.001 THEN 'out_of_range' WHEN n = 5 AND (v[3] <= 0 OR v[4] <= 0) THEN 'empty_box' END AS reason FROM val)"""


@query("a05_parse_labels", f"WITH {LABELS} SELECT image_id, line_no, class_id, CASE WHEN n = 5 THEN 'box' ELSE 'polygon' END AS kind, round(v[1], 6) AS first_value FROM lab WHERE reason IS NULL")
def a05(t):
    rows = O.parse_labels(t("yolo_lines"), 3).filter("reason IS NULL")
    return rows.select("image_id", "line_no", "class_id", "kind", F.round(F.get("coords", F.lit(0)), 6).alias("first_value"))


@query("a05_label_rejects", f"WITH {LABELS} SELECT image_id, line_no, reason FROM lab WHERE reason IS NOT NULL")
def a05_rejects(t):
    return O.parse_labels(t("yolo_lines"), 3).filter("reason IS NOT NULL").select("image_id", "line_no", "reason")


@query("j04_parse_annotation", f"WITH {LABELS} SELECT image_id, line_no, class_id, CASE WHEN n = 5 THEN 'box' ELSE 'polygon' END AS kind, round(v[1], 6) AS first_value, reason FROM lab")
def j04(t):
    """The lines of each image as one text, parsed by the table function."""
    lines = F.array_sort(F.collect_list(F.struct("line_no", "line")))
    files = t("yolo_lines").groupBy("image_id").agg(F.array_join(F.transform(lines, lambda x: x["line"]), "\n").alias("text"))
    rows = O.parse_annotation_files(files, 3)
    return rows.select("image_id", "line_no", "class_id", "kind", F.round(F.get("coords", F.lit(0)), 6).alias("first_value"), "reason")


@query("a06_load_classes", """WITH l AS (SELECT CAST(p_partkey AS INT) AS class_id, trim(CASE WHEN p_partkey % 40 = 0 THEN ' ' ELSE p_name END) AS name FROM part)
SELECT class_id, name, CASE WHEN name = '' THEN 'empty' WHEN (SELECT count(*) FROM l m WHERE m.name = l.name) > 1 THEN 'duplicate' END AS reason FROM l""")
def a06(t):
    line = F.when(F.col("p_partkey") % 40 == 0, " ").otherwise(F.concat(F.lit(" "), "p_name"))
    return O.load_classes(t("part").select(F.col("p_partkey").alias("line_no"), line.alias("line")))


def _field(k):
    return f"TRY_CAST(nullif(regexp_extract(text, '[ ]{k}=\"([^\"]*)\"', 1), '') AS DOUBLE)"


@query("a07_extract_photo_meta", f"SELECT photo_id, coalesce(nullif({_field('AbsoluteAltitude')}, 0e0), nullif({_field('RelativeAltitude')}, 0e0), 0e0) AS altitude, coalesce({_field('GimbalYawDegree')}, {_field('FlightYawDegree')}, 0e0) AS yaw, coalesce({_field('GimbalPitchDegree')}, -45e0) AS pitch FROM photo_text")
def a07(t):
    return O.photo_meta(t("photo_text")).select("photo_id", "altitude", "yaw", "pitch")


@query("a14_next_version", """WITH n AS (SELECT lower(p_brand || CASE p_partkey % 3 WHEN 0 THEN '_V' WHEN 1 THEN '_v' ELSE '_x' END || p_partkey) AS name FROM part), f AS (SELECT DISTINCT p_brand AS family FROM part UNION SELECT DISTINCT replace(p_brand, '#', '.') FROM part)
SELECT family, coalesce((SELECT max(CAST(substr(name, length(family) + 3) AS BIGINT)) FROM n WHERE starts_with(name, lower(family) || '_v')), 0) + 1 AS version FROM f""")
def a14(t):
    """Folders of all brands; of a brand with a dot in place of its number sign there are none."""
    names = t("part").select(F.concat("p_brand", F.element_at(F.array(F.lit("_V"), F.lit("_v"), F.lit("_x")), (F.col("p_partkey") % 3 + 1).cast("int")), F.col("p_partkey").cast("string")).alias("name"))
    brands = t("part").select(F.col("p_brand").alias("family"))
    return O.next_versions(names, brands.union(brands.select(F.replace("family", F.lit("#"), F.lit(".")))).distinct())


@query("c01_attach_labels", "SELECT i.image_id, i.source, l.quality, l.doc_id IS NULL AS missing FROM documents_labelled i LEFT JOIN labels l ON i.image_id = l.doc_id")
def c01(t):
    labels = t("labels").select(F.col("doc_id").alias("image_id"), "quality")
    return O.attach_labels(t("documents_labelled").select("image_id", "source"), labels, "image_id")


@query("c02_orphan_labels", "SELECT image_id, count(*) AS boxes FROM boxes WHERE image_id NOT IN (SELECT image_id FROM images WHERE source <> 'src1') GROUP BY image_id")
def c02(t):
    return O.orphan_labels(t("boxes"), t("images").filter("source <> 'src1'"), "image_id").groupBy("image_id").agg(F.count("*").alias("boxes"))


STEMS = "CASE WHEN image_id % 2 = 0 THEN 'IMG_' ELSE 'img_' END || CAST(floor(image_id / 3e0) AS BIGINT)"


@query("c03_ambiguous_stems", f"WITH s AS (SELECT image_id, {STEMS} AS stem FROM images WHERE source <> 'src2') SELECT image_id, stem FROM s WHERE (SELECT count(*) FROM s b WHERE lower(b.stem) = lower(s.stem)) > 1")
def c03(t):
    stem = F.concat(F.when(F.col("image_id") % 2 == 0, "IMG_").otherwise("img_"), F.floor(F.col("image_id") / 3).cast("string"))
    return O.ambiguous(t("images").filter("source <> 'src2'").select("image_id", stem.alias("stem")), "stem")


@query("c04_conflicting_annotations", "SELECT sha256(content) AS content_hash, count(*) AS images, count(DISTINCT coalesce(CAST(quality AS VARCHAR), 'none')) AS annotations FROM documents_labelled GROUP BY content HAVING count(DISTINCT coalesce(CAST(quality AS VARCHAR), 'none')) > 1")
def c04(t):
    return O.conflicting(t("documents_labelled"), "content", F.coalesce(F.col("quality").cast("string"), F.lit("none")))


@query("d23_class_stats", """WITH i AS (SELECT * FROM images WHERE source <> 'src0'), b AS (SELECT * FROM boxes WHERE image_id IN (SELECT image_id FROM i))
SELECT 'class_' || class_id AS metric, count(DISTINCT image_id) AS images, count(*) AS boxes FROM b GROUP BY class_id UNION ALL SELECT 'background', count(*), 0 FROM i WHERE image_id NOT IN (SELECT image_id FROM boxes) UNION ALL SELECT 'total', count(*), (SELECT count(*) FROM b) FROM i""")
def d23(t):
    return O.class_stats(t("images").filter("source <> 'src0'"), t("boxes"))


@query("d24_duplicate_groups", "SELECT sha256(content) AS content_hash, count(*) AS images, min(image_id) AS first_id, max(image_id) AS last_id FROM images GROUP BY content HAVING count(*) > 1")
def d24(t):
    return O.duplicate_groups(t("images"), "content", "image_id")


ROLE = "CASE WHEN source IN ('src0', 'src1') THEN 'previous' ELSE 'new' END"


@query("d25_source_counts", f"SELECT role, source, count(*) AS images FROM (SELECT *, {ROLE} AS role FROM images) x GROUP BY ROLLUP (role, source)")
def d25(t):
    return O.source_counts(t("images").withColumn("role", F.expr(ROLE)))


@query("f02_order_sources", "SELECT image_id, row_number() OVER (ORDER BY CASE WHEN source = 'src3' THEN 0 ELSE 1 END, source, rel_path) AS seq FROM images")
def f02(t):
    return O.order_sources(t("images"), F.when(F.col("source") == "src3", 0).otherwise(1)).select("image_id", "seq")


@query("g01_merge_sources", "SELECT image_id, role, printf('image_%08d.jpg', n) AS file FROM (SELECT image_id, CASE WHEN source = 'src4' THEN 'previous' ELSE 'new' END AS role, row_number() OVER (ORDER BY CASE WHEN source = 'src4' THEN 0 ELSE 1 END, source, rel_path) AS n FROM images) x")
def g01(t):
    i = t("images")
    return O.merge_sources(i.filter("source = 'src4'"), i.filter("source <> 'src4'")).select("image_id", "role", "file")


@query("g03_new_only_images", "SELECT DISTINCT sha256(content) AS content_hash FROM images WHERE source <> 'src0' AND content NOT IN (SELECT content FROM images WHERE source = 'src0')")
def g03(t):
    i = t("images")
    return O.new_only(i.filter("source = 'src0'"), i.filter("source <> 'src0'"))


@query("a14_next_run", """WITH f AS (SELECT 'clip_' || CASE WHEN p_partkey < 10 THEN '0' ELSE '' END || p_partkey AS name, p_partkey AS n FROM part WHERE p_partkey % 37 <> 0 AND p_partkey >= 2 UNION ALL SELECT 'clip', NULL)
SELECT 'clip_' || CASE WHEN min(n + 1) < 10 THEN '0' ELSE '' END || min(n + 1) AS folder FROM f WHERE n + 1 NOT IN (SELECT n FROM f WHERE n IS NOT NULL)""")
def a14_run(t):
    """Folders of earlier runs, with gaps."""
    number = F.format_string("clip_%02d", "p_partkey")
    names = t("part").filter("p_partkey % 37 <> 0 AND p_partkey >= 2").select(number.alias("name"))
    return O.next_run(names.unionByName(t("part").limit(1).select(F.lit("clip").alias("name"))), "clip")


UNITS = """lab AS (SELECT i.image_id, sha256(i.content) AS content_hash, coalesce(c.vector, '') AS vector FROM images i LEFT JOIN (SELECT image_id, string_agg(class_id || ':' || n, ',' ORDER BY class_id) AS vector FROM (SELECT image_id, class_id, count(*) AS n FROM boxes GROUP BY ALL) x GROUP BY image_id) c ON i.image_id = c.image_id),
units AS (SELECT content_hash, count(*) AS size, arg_min(vector, image_id) AS vector FROM lab GROUP BY content_hash)"""


def _hash():
    """The text of packed hashes."""
    return F.lower(F.hex("content_hash")).alias("content_hash")


def _assigned(t):
    """The content hashes are bytes."""
    return O.split_groups(O.content_units(t("images"), t("boxes"), packed=True), "s1", strict=True)


@query("h01_stratified_group_split", None)
def h01(t):
    """The search for quotas is no SQL; the tests hold the split against its rules, and the report's twin tells what each metric must reach."""
    return _assigned(t).select(_hash(), "size", "vector", "split")


@query("h01_content_units", f"WITH {UNITS} SELECT content_hash, size, vector FROM units")
def h01_units(t):
    return _assigned(t).select(_hash(), "size", "vector")


@query("h02_split_report", f"""WITH {UNITS}, p AS (SELECT size, string_split(x, ':') AS kc FROM (SELECT size, unnest(string_split(vector, ',')) AS x FROM units WHERE vector <> '') y),
m AS (SELECT 'images' AS metric, size FROM units UNION ALL SELECT 'background_images', size FROM units WHERE vector = '' UNION ALL SELECT 'class_' || kc[1] || '_images', size FROM p UNION ALL SELECT 'class_' || kc[1] || '_boxes', size * CAST(kc[2] AS BIGINT) FROM p),
r AS (SELECT metric, CAST(sum(size) AS BIGINT) AS total FROM m GROUP BY metric)
SELECT metric, total, CAST(floor(7 * total / 10e0) AS BIGINT) AS least, CAST(ceil(7 * total / 10e0) AS BIGINT) AS most, true AS within_rounding, total % 10 = 0 AS exact_7_3 FROM r""")
def h02(t):
    """Every metric must be within rounding, and exact where ten divides it."""
    return O.split_report(_assigned(t)).select("metric", "total", "least", "most", "within_rounding", "exact_7_3")


@query("h03_split_leakage", "WITH s AS (SELECT DISTINCT sha256(content) AS content_hash, source = 'src1' AS val FROM images) SELECT content_hash, count(*) AS splits FROM s GROUP BY content_hash HAVING count(*) > 1")
def h03(t):
    """The split itself must leak nothing. One source put into val and all others into train leaks the contents that they share."""
    images = t("images").select("source", O.packed_hash("content").alias("content_hash"))
    own = images.select("content_hash").join(_assigned(t).select("content_hash", "split"), "content_hash")
    by_source = images.withColumn("split", F.when(F.col("source") == "src1", "val").otherwise("train"))
    leaks = O.split_leakage(own).unionByName(O.split_leakage(by_source))
    return leaks.select(_hash(), "splits")


@query("h07_build_dataset", """SELECT image_id, source, printf('image_%08d.jpg', row_number() OVER (ORDER BY CASE WHEN source = 'src0' THEN 0 ELSE 1 END, source, rel_path)) AS file, false AS leaked FROM images""")
def h07(t):
    """All images, many of them in several copies, the source src0 as the previous version; written by split and read again. Copies lie in one split."""
    images = t("images")
    folder = f"{shared_folder(t.spark)}/dataset-{uuid.uuid4().hex}"
    out = O.build_dataset(images.filter("source = 'src0'"), images.filter("source <> 'src0'"), t("boxes"), folder, "s1", strict=True)
    leaks = materialize(O.split_leakage(out.withColumn("content_hash", F.unhex("content_hash"))))
    few = leaks.select(_hash(), F.lit(True).alias("leaked"))
    return out.join(F.broadcast(few) if leaks.count() <= 100_000 else few, "content_hash", "left").select("image_id", "source", "file", F.coalesce("leaked", F.lit(False)).alias("leaked"))


@query("h04_strip_split_prefix", "SELECT p AS path, count(*) AS images FROM (SELECT regexp_replace(CASE WHEN image_id % 3 = 0 THEN 'val/' ELSE '' END || 'train/a/img_' || (image_id // 2) || '.jpg', '^((train|val|valid|test)/)+', '') AS p FROM images) x GROUP BY p HAVING count(*) > 1")
def h04(t):
    path = F.concat(F.when(F.col("image_id") % 3 == 0, "val/").otherwise(""), F.lit("train/a/img_"), F.floor(F.col("image_id") / 2).cast("string"), F.lit(".jpg"))
    return O.stripped_conflicts(t("images").select(path.alias("rel_path")))


@query("h05_validate_output", "SELECT image_id, 'missing' AS problem FROM images WHERE source = 'src2' AND image_id % 7 = 0 UNION ALL SELECT image_id, 'unexpected' FROM images WHERE source = 'src3'")
def h05(t):
    i = t("images")
    return O.validate_output(i.filter("NOT (source = 'src2' AND image_id % 7 = 0)"), i.filter("source <> 'src3'"), "image_id")


@query("h06_class_map_drift", """SELECT coalesce(a.p_partkey, b.p_partkey) AS class_id, a.p_brand AS old_name, b.n AS new_name FROM (SELECT * FROM part WHERE p_partkey % 5 <> 0) a
FULL JOIN (SELECT p_partkey, CASE WHEN p_partkey % 11 = 0 THEN p_type ELSE p_brand END AS n FROM part WHERE p_partkey % 7 <> 0) b ON a.p_partkey = b.p_partkey WHERE a.p_brand IS DISTINCT FROM b.n""")
def h06(t):
    p = t("part")
    now = p.filter("p_partkey % 7 <> 0").select("p_partkey", F.when(F.col("p_partkey") % 11 == 0, F.col("p_type")).otherwise(F.col("p_brand")))
    return O.class_map_drift(p.filter("p_partkey % 5 <> 0").select("p_partkey", "p_brand"), now)
