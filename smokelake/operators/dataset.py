"""Curating labelled image sets: parsing annotations, conflicts, merging versions, a balanced split free of leaks."""

from __future__ import annotations

import math
import re
import zlib

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .balance import balance
from .shared import materialize

#: File endings in order of preference, as they are written (fixed values).
VIDEO_ENDINGS = ("MP4", "mp4", "MOV", "mov", "AVI", "avi")
IMAGE_ENDINGS = ("JPG", "jpg", "JPEG", "jpeg", "PNG", "png")


def pair_media(files: DataFrame, path: str = "path") -> DataFrame:
    """One row for each folder and stem with a video `<stem>_V.<ending>` and an image `<stem>_P.<ending>` in it: the best ending of each.

    A stem without a video of a known ending takes the first other file `<stem>_V.*` of its folder. Files of different folders are never paired.
    """
    part = lambda k: F.regexp_extract(path, r"(?s)^(.*/)?([^/]*)_([VP])\.([^/]+)$", k)
    rows = files.select(F.col(path).alias("path"), part(1).alias("folder"), part(2).alias("stem"), part(3).alias("kind"), part(4).alias("ending")).filter("kind <> ''")

    def side(kind: str, endings: tuple[str, ...], out: str, others: bool) -> DataFrame:
        rank = F.array_position(F.array(*map(F.lit, endings)), F.col("ending"))
        rank = F.when((rank == 0) & others, len(endings) + 1).otherwise(rank)
        best = F.min(F.struct(rank.alias("rank"), "path"))
        return rows.filter((F.col("kind") == kind) & (rank > 0)).groupBy("folder", "stem").agg(best["path"].alias(out))

    return side("V", VIDEO_ENDINGS, "video", True).join(side("P", IMAGE_ENDINGS, "image", False), ["folder", "stem"])


#: White space of any script.
_BLANK = r"(?U)[\s\x1c-\x1f]"
#: What counts as a number in an annotation; other engines' suffixes (as in 1d) don't.
_NUMBER = r"(?i)[+-]?(?:(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:e[+-]?[0-9]+)?|inf|infinity|nan)"


def parse_labels(lines: DataFrame, n_classes: int, key: str = "image_id") -> DataFrame:
    """Every annotation line with its class, box (four numbers) or polygon, and the reason why it is rejected (null: accepted). Blank lines are skipped.

    Five tokens are a box, an odd number from seven a polygon. The class must be known, values finite and in [-0.001, 1.001],
    and a box must have width and height.
    """
    tokens = F.filter(F.split("line", rf"{_BLANK}+"), lambda x: x != "")
    once = lambda c: F.explode(F.array(c))  # noqa: E731  a filter on the result is not carried below it, with a copy of the work for each use
    rows = lines.select(key, "line_no", once(tokens).alias("t")).filter(F.size("t") > 0)
    n = F.size("t")
    coords = F.transform(F.slice("t", 2, F.greatest(n - 1, F.lit(0))), lambda x: F.when(x.rlike(f"^(?:{_NUMBER})$"), x.try_cast("double")))
    rows = rows.select(key, "line_no", n.alias("n"), F.get("t", F.lit(0)).try_cast("int").alias("class_id"), once(coords).alias("coords"))
    known = F.coalesce((F.col("class_id") >= 0) & (F.col("class_id") < n_classes), F.lit(False))
    finite = F.forall("coords", lambda v: F.coalesce(v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))), F.lit(False)))
    inside = F.forall("coords", lambda v: F.coalesce((v >= -0.001) & (v <= 1.001), F.lit(False)))
    flat = (F.col("n") == 5) & ((F.get("coords", F.lit(2)) <= 0) | (F.get("coords", F.lit(3)) <= 0))
    reason = (
        F.when((F.col("n") != 5) & ((F.col("n") < 7) | (F.col("n") % 2 == 0)), "token_count").when(~known, "unknown_class")
        .when(~finite, "not_a_number").when(~inside, "out_of_range").when(flat, "empty_box")
    )
    return rows.withColumn("reason", reason).withColumn("kind", F.when(F.col("n") == 5, "box").otherwise("polygon"))


@F.udtf(returnType="line_no int, class_id int, kind string, coords array<double>, reason string")
class ParseAnnotation:
    """The lines of an annotation file as rows, by the rules of parse_labels: for LATERAL parse_annotation(text, n_classes). Null texts have no lines."""

    def eval(self, text: str, n_classes: int):
        for number, line in enumerate((text or "").split("\n"), 1):
            tokens = line.split()
            if not tokens:
                continue
            n, class_id = len(tokens), int(tokens[0]) if re.fullmatch(r"[+-]?[0-9]{1,9}", tokens[0]) else None
            coords = [float(v) if re.fullmatch(_NUMBER, v) else None for v in tokens[1:]]
            if n != 5 and (n < 7 or n % 2 == 0):
                reason = "token_count"
            elif class_id is None or not 0 <= class_id < n_classes:
                reason = "unknown_class"
            elif any(v is None or not math.isfinite(v) for v in coords):
                reason = "not_a_number"
            elif not all(-0.001 <= v <= 1.001 for v in coords):
                reason = "out_of_range"
            else:
                reason = "empty_box" if n == 5 and min(coords[2:]) <= 0 else None
            yield number, class_id, "box" if n == 5 else "polygon", coords, reason


def register_annotation_parser(spark: SparkSession) -> None:
    """Makes parse_annotation known to the session's SQL."""
    spark.udtf.register("parse_annotation", ParseAnnotation)


def parse_annotation_files(files: DataFrame, n_classes: int, text: str = "text") -> DataFrame:
    """The files with a row for each annotation line: line_no, class_id, kind, coords and reason (null: accepted). Other columns pass through."""
    spark = files.sparkSession
    register_annotation_parser(spark)
    return spark.sql(f"SELECT f.*, a.* FROM {{files}} f, LATERAL parse_annotation(f.`{text}`, {int(n_classes)}) a", files=files)


def load_classes(lines: DataFrame) -> DataFrame:
    """Class names by line (id from 0), trimmed, with a reason where a name is empty or occurs twice; columns line_no (from 0) and line."""
    rows = lines.select(F.col("line_no").cast("int").alias("class_id"), F.trim("line").alias("name"))
    count = F.count("*").over(Window.partitionBy("name"))
    return rows.withColumn("reason", F.when(F.col("name") == "", "empty").when(count > 1, "duplicate"))


def photo_meta(photos: DataFrame, text: str = "text") -> DataFrame:
    """altitude, yaw and pitch from Key="value" texts: absolute, else relative altitude, else 0 (zero counts as missing); gimbal, else flight yaw, else 0; gimbal pitch, else -45."""
    field = lambda k: F.regexp_extract(text, rf'(?:^|[\s:]){k}="([^"]*)"', 1).try_cast("double")
    altitude = F.coalesce(F.nullif(field("AbsoluteAltitude"), F.lit(0.0)), F.nullif(field("RelativeAltitude"), F.lit(0.0)), F.lit(0.0))
    return photos.withColumns({"altitude": altitude, "yaw": F.coalesce(field("GimbalYawDegree"), field("FlightYawDegree"), F.lit(0.0)), "pitch": F.coalesce(field("GimbalPitchDegree"), F.lit(-45.0))})


def next_versions(names: DataFrame, families: DataFrame, name: str = "name", family: str = "family") -> DataFrame:
    """The families with version: the one after the highest `<family>_v<number>` (any case), or 1. Names are read apart, so no character of a family is a pattern."""
    part = lambda k: F.regexp_extract(F.lower(name), r"(?s)^(.*)_v([0-9]+)$", k)
    found = names.select(part(1).alias("_family"), F.nullif(part(2), F.lit("")).try_cast("long").alias("_n")).groupBy("_family").agg(F.max("_n").alias("_n"))
    rows = families.join(found, F.lower(family) == F.col("_family"), "left")
    return rows.withColumn("version", F.coalesce("_n", F.lit(0)) + 1).drop("_family", "_n")


def next_version(names: DataFrame, family: str, name: str = "name") -> DataFrame:
    """One row: the version of one family."""
    return next_versions(names, names.sparkSession.createDataFrame([(family,)], "family string"), name).select("version")


def next_run(names: DataFrame, stem: str, name: str = "name") -> DataFrame:
    """One row: the folder of the next run, the stem itself or else the first free `<stem>_<number>` from 02. The stem is compared as it is."""
    head = F.lit(f"{stem}_")
    tail = F.when(F.startswith(F.col(name), head), F.substring(F.col(name), F.lit(len(stem) + 2), F.length(name)))
    used = names.select(F.col(name).alias("name"), F.when(tail.rlike("^[0-9]{2,18}$"), tail.try_cast("long")).alias("n"))
    used = used.withColumn("n", F.when(F.col("name") == F.concat(head, F.format_string("%02d", "n")), F.col("n")))
    taken = used.agg(F.coalesce(F.max(F.col("name") == F.lit(stem)), F.lit(False)).alias("taken"), F.coalesce(F.max(F.col("n") == 2), F.lit(False)).alias("two"))
    after = used.filter("n >= 2").select((F.col("n") + 1).alias("n")).join(used.select("n"), "n", "left_anti").agg(F.min("n").alias("free"))
    second = F.when(~F.col("two"), F.lit(2)).otherwise(after.scalar())
    return taken.select(F.when(~F.col("taken"), F.lit(stem)).otherwise(F.concat(head, F.format_string("%02d", second))).alias("folder"))


def attach_labels(images: DataFrame, labels: DataFrame, key: str) -> DataFrame:
    """All images; those without a label are background and flagged missing."""
    rows = images.join(labels.withColumn("_has", F.lit(True)), key, "left")
    return rows.withColumn("missing", F.col("_has").isNull()).drop("_has")


def orphan_labels(labels: DataFrame, images: DataFrame, key: str, metadata: tuple[str, ...] = ("classes", "data")) -> DataFrame:
    """Labels without an image, less names of metadata files."""
    return labels.join(images, key, "left_anti").filter(~F.col(key).cast("string").isin(*metadata))


def ambiguous(images: DataFrame, stem: str) -> DataFrame:
    """Images whose stem, letter case aside, occurs twice or more."""
    low = images.withColumn("_low", F.lower(stem))
    twice = low.groupBy("_low").count().filter("count > 1").select("_low")
    return low.join(twice, "_low", "left_semi").drop("_low")


def conflicting(images: DataFrame, content: str, annotation: Column) -> DataFrame:
    """Content hashes that carry different annotations, with the number of images and annotations."""
    rows = images.select(F.sha2(F.col(content).cast("binary"), 256).alias("content_hash"), annotation.alias("a"))
    return rows.groupBy("content_hash").agg(F.count("*").alias("images"), F.count_distinct("a").alias("annotations")).filter("annotations > 1")


def order_sources(images: DataFrame, rank: Column) -> DataFrame:
    """Global sequence number from 1: by rank (previous version first), source, path.

    Numbers come from sums over ranges of the sorted rows, so no task holds all of them: range partitions are counted, and
    each row adds the rows of the partitions before its own. A row's number within its partition is the lower part of Spark's
    increasing id, so rows are shuffled once.
    """
    rows = images.withColumn("_rank", rank).repartitionByRange("_rank", "source", "rel_path").sortWithinPartitions("_rank", "source", "rel_path").drop("_rank")
    rows = materialize(rows.withColumn("_at", F.monotonically_increasing_id()))  # both uses must see one partitioning
    rows = rows.withColumns({"_part": F.shiftright("_at", 33), "_within": F.col("_at").bitwiseAND(F.lit((1 << 33) - 1)) + 1})
    counts = rows.groupBy("_part").count()
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # one row for each partition
    counts = counts.withColumn("_before", F.coalesce(F.sum("count").over(before), F.lit(0))).drop("count")
    return rows.join(F.broadcast(counts), "_part").withColumn("seq", (F.col("_before") + F.col("_within")).cast("long")).drop("_part", "_at", "_within", "_before")


def merge_sources(previous: DataFrame, new: DataFrame, ending: str = "jpg") -> DataFrame:
    """Previous version first, then the new sources, renumbered to image_%08d names."""
    both = previous.withColumn("role", F.lit("previous")).unionByName(new.withColumn("role", F.lit("new")))
    rows = order_sources(both, F.when(F.col("role") == "previous", 0).otherwise(1))
    return rows.withColumn("file", F.format_string(f"image_%08d.{ending}", "seq"))


def class_stats(images: DataFrame, boxes: DataFrame, key: str = "image_id") -> DataFrame:
    """The images that contain a class and its boxes, for each class; and the images without a box (background) and all images, with all boxes, in total."""
    own = boxes.join(images.select(key), key, "left_semi")
    by_class = own.groupBy(F.concat(F.lit("class_"), F.col("class_id").cast("string")).alias("metric")).agg(F.count_distinct(key).alias("images"), F.count("*").alias("boxes"))
    background = images.join(boxes, key, "left_anti").agg(F.lit("background").alias("metric"), F.count("*").alias("images"), F.lit(0).cast("long").alias("boxes"))
    total = images.agg(F.lit("total").alias("metric"), F.count("*").alias("images"), own.agg(F.count("*")).scalar().alias("boxes"))
    return by_class.unionByName(background).unionByName(total)


def duplicate_groups(images: DataFrame, content: str, key: str) -> DataFrame:
    """Groups of two or more images with the same content: their number and first id."""
    rows = images.groupBy(F.sha2(F.col(content).cast("binary"), 256).alias("content_hash"))
    return rows.agg(F.count("*").alias("images"), F.min(key).alias("first_id"), F.max(key).alias("last_id")).filter("images > 1")


def source_counts(images: DataFrame) -> DataFrame:
    """Images by role and source, with totals (null) by rollup."""
    return images.rollup("role", "source").agg(F.count("*").alias("images"))


def _amounts(counted: Column | str = "size") -> Column:
    """What a group of equal images counts in each metric: an array of structs metric and amount, `counted` in place of its size."""
    size = F.col(counted) if isinstance(counted, str) else counted
    one = lambda m, n: F.struct(m.alias("metric"), n.cast("long").alias("amount"))
    pairs = F.filter(F.split("vector", ","), lambda p: p != "")
    named = lambda p, kind: F.concat(F.lit("class_"), F.substring_index(p, ":", 1), F.lit(kind))
    classes = F.transform(pairs, lambda p: F.array(one(named(p, "_images"), size), one(named(p, "_boxes"), size * F.substring_index(p, ":", -1).cast("long"))))
    background = F.when(F.col("vector") == "", F.array(one(F.lit("background_images"), size))).otherwise(F.array().cast("array<struct<metric:string,amount:bigint>>"))
    return F.concat(F.array(one(F.lit("images"), size)), background, F.flatten(classes))


def split_groups(units: DataFrame, seed: str, strict: bool = False, pool: int = 20_000) -> DataFrame:
    """Assign every content group to train or val so that every metric is 7 tenths of its total, rounded down or up: all images ((7 * images + 5) div 10 of them), and each class's images and boxes, and background images.

    units: one row for each group of equal content: content_hash, size (its images) and vector (its class counts as text).
    Groups of one size and vector form a stratum; 7 tenths of its groups, rounded by a seeded hash, go to train. What the metrics then miss is
    mended by an exchange of groups between strata (balance.py), which sees the sums of all strata and a pool of those with the fewest
    boxes. With strict, a split that is not within rounding raises.

    Within a stratum the order is a seeded hash. Groups are counted by slots of the hash, and ranked one by one within a slot alone, so a
    stratum of a third of all groups spreads over 65,536 of them. The groups are made once and read from a checkpoint. content_hash
    may be text or its bytes (content_units with packed), which halves what is shuffled; the order is that of the text.
    """
    return _split(materialize(units), seed, strict, pool)


def _split(units: DataFrame, seed: str, strict: bool, pool: int = 20_000) -> DataFrame:
    """split_groups of a table that is cheap to read again."""
    strata = units.groupBy("size", "vector").agg(F.count("*").alias("n"))
    up = F.pmod(F.xxhash64(F.lit(seed), "size", "vector"), F.lit(10)) < F.col("n") * 7 % 10
    strata = materialize(strata.withColumn("base", F.floor(F.col("n") * 7 / 10).cast("long") + up.cast("long")))
    sums = strata.select("n", "base", F.explode(_amounts()).alias("a")).groupBy("a.metric").agg(F.sum(F.col("n") * F.col("a.amount")).alias("total"), F.sum(F.col("base") * F.col("a.amount")).alias("train")).collect()
    few = strata.orderBy("size", F.length("vector"), F.desc("n"), "vector").limit(pool).select("size", "vector", "n", "base").collect()
    changes, missed = balance(few, {r.metric: r.total for r in sums}, {r.metric: r.train for r in sums}, zlib.crc32(seed.encode()))
    if strict and missed:
        raise ValueError("the split is not within rounding of 70:30")
    sizes = {f.name: f.dataType.simpleString() for f in units.schema}
    changed = units.sparkSession.createDataFrame(changes, f"size {sizes['size']}, vector string, change long")
    quotas = strata.join(F.broadcast(changed), ["size", "vector"], "left").select("size", "vector", (F.col("base") + F.coalesce("change", F.lit(0))).alias("_quota"))
    text = F.lower(F.hex("content_hash")) if units.schema["content_hash"].dataType.simpleString() == "binary" else F.col("content_hash")
    order = F.sha2(F.concat(F.lit(seed), text), 256)
    keyed = units.withColumn("_slot", F.substring(order, 1, 4))
    slots = keyed.groupBy("size", "vector", "_slot").agg(F.count("*").alias("_held"))
    before = F.sum("_held").over(Window.partitionBy("size", "vector").orderBy("_slot").rowsBetween(Window.unboundedPreceding, -1))
    slots = slots.withColumn("_before", F.coalesce(before, F.lit(0))).join(quotas, ["size", "vector"]).drop("_held")
    rows = keyed.join(slots, ["size", "vector", "_slot"]).withColumn("_key", F.unhex(order))  # made behind the shuffle, not carried through it
    place = F.col("_before") + F.row_number().over(Window.partitionBy("size", "vector", "_slot").orderBy("_key", "content_hash"))
    return rows.withColumn("split", F.when(place <= F.col("_quota"), "train").otherwise("val")).select(*units.columns, "split")


def split_report(assigned: DataFrame, strict: bool = False) -> DataFrame:
    """For all images, each class's images and boxes, and background images: the number in total and in train, the fraction, the least and most (7 tenths rounded down and up), and whether train is between them. With strict, a miss raises."""
    rows = assigned.select((F.col("split") == "train").alias("in"), F.explode(_amounts()).alias("a"))
    out = rows.groupBy("a.metric").agg(F.sum("a.amount").alias("total"), F.sum(F.when(F.col("in"), F.col("a.amount")).otherwise(0)).alias("train"))
    share = 7 * F.col("total") / 10
    out = out.withColumns({"fraction": F.col("train") / F.col("total"), "exact_7_3": 10 * F.col("train") == 7 * F.col("total"), "least": F.floor(share), "most": F.ceil(share)})
    out = out.withColumn("within_rounding", F.col("train").between(F.col("least"), F.col("most")))
    if strict and not out.filter(~F.col("within_rounding")).isEmpty():
        raise ValueError("the split is not within rounding of 70:30")
    return out


def split_leakage(images: DataFrame) -> DataFrame:
    """Content hashes that occur in both splits."""
    return images.groupBy("content_hash").agg(F.size(F.collect_set("split")).cast("long").alias("splits")).filter("splits > 1")


def strip_split_prefix(path) -> Column:
    """A path less leading train, val, valid and test folders; the file name stays."""
    return F.regexp_replace(path, r"^(?:(?:train|val|valid|test)/)+(?=.)", "")


def stripped_conflicts(images: DataFrame, path: str = "rel_path") -> DataFrame:
    rows = images.groupBy(strip_split_prefix(path).alias("path")).agg(F.count("*").alias("images"))
    return rows.filter("images > 1")


def class_map_drift(previous: DataFrame, current: DataFrame) -> DataFrame:
    """Class ids whose name changed, came or went between two versions."""
    rows = previous.toDF("class_id", "old_name").join(current.toDF("class_id", "new_name"), "class_id", "full")
    return rows.filter(~F.col("old_name").eqNullSafe(F.col("new_name")))


def validate_output(written: DataFrame, expected: DataFrame, key: str) -> DataFrame:
    """Keys on one side only, and which: no row means that what was written is complete."""
    lost = expected.join(written, key, "left_anti").select(key, F.lit("missing").alias("problem"))
    return lost.unionByName(written.join(expected, key, "left_anti").select(key, F.lit("unexpected").alias("problem")))


def packed_hash(content: str) -> Column:
    """The 32 bytes of a content's hash, for shuffles: half of its text, and random digits don't compress."""
    return F.unhex(F.sha2(F.col(content).cast("binary"), 256))


def _grouped(rows: DataFrame, *more: Column) -> DataFrame:
    """Groups of one content_hash with size and the vector of the first image."""
    return rows.groupBy("content_hash").agg(F.count("*").alias("size"), F.min(F.struct("image_id", "vector"))["vector"].alias("vector"), *more)


def content_units(images: DataFrame, boxes: DataFrame, packed: bool = False) -> DataFrame:
    """Groups of equal content with size and vector (`class:boxes`, by class, comma-joined; empty for background), for split_groups; a content's vector is that of its first image. With packed, content_hash is bytes, not text."""
    counts = boxes.groupBy("image_id", "class_id").agg(F.count("*").alias("n")).groupBy("image_id").agg(F.array_sort(F.collect_list(F.struct("class_id", "n"))).alias("counts"))
    vector = F.array_join(F.transform("counts", lambda x: F.concat_ws(":", x["class_id"].cast("string"), x["n"].cast("string"))), ",")
    rows = images.select("image_id", packed_hash("content").alias("content_hash")).join(counts, "image_id", "left").withColumn("vector", F.coalesce(vector, F.lit("")))
    units = _grouped(rows)
    return units if packed else units.withColumn("content_hash", F.lower(F.hex("content_hash")))


def new_only(previous: DataFrame, new: DataFrame, content: str = "content") -> DataFrame:
    """Content hashes of new images that the previous version doesn't hold, once each."""
    hashed = lambda df: df.select(F.sha2(F.col(content).cast("binary"), 256).alias("content_hash"))
    return hashed(new).subtract(hashed(previous))


def build_dataset(previous: DataFrame, new: DataFrame, boxes: DataFrame, path: str, seed: str, strict: bool = False) -> DataFrame:
    """Merge, refuse conflicting annotations, split without leaks and write by split; returns the assignment that was written. The folder must not exist yet.

    The boxes of an image are gathered once, for its vector and its annotation, whose SHA-256 (16 bytes of it) travels in place of its text.
    """
    merged = merge_sources(previous, new).withColumn("content_hash", packed_hash("content"))
    own = boxes.groupBy("image_id").agg(F.array_sort(F.collect_list(F.struct("class_id", "cx", "cy", "bw", "bh"))).alias("own"))
    boxes_of = lambda c: F.size(F.filter("own", lambda x: x["class_id"].eqNullSafe(c))).cast("string")
    vector = F.transform(F.array_distinct(F.transform("own", lambda x: x["class_id"])), lambda c: F.concat_ws(":", c.cast("string"), boxes_of(c)))
    own = own.select("image_id", F.array_join(vector, ",").alias("vector"), F.to_json("own").alias("annotation"))
    digest = F.substring(F.unhex(F.sha2(F.col("annotation").cast("binary"), 256)), 1, 16)
    labelled = merged.select("image_id", "content_hash").join(own.select("image_id", "vector", digest.alias("digest")), "image_id", "left")
    labelled = labelled.select("image_id", "content_hash", F.coalesce("vector", F.lit("")).alias("vector"), F.coalesce("digest", F.lit(b"")).alias("digest"))
    units = materialize(_grouped(labelled, (F.min("digest") != F.max("digest")).alias("conflict")))
    if not units.filter("conflict").isEmpty():
        raise ValueError("equal images carry different annotations")
    assigned = _split(units.drop("conflict"), seed, strict)
    rows = merged.join(assigned.select("content_hash", "split"), "content_hash").withColumn("content_hash", F.lower(F.hex("content_hash")))
    rows.write.partitionBy("split").mode("errorifexists").parquet(path)
    return previous.sparkSession.read.parquet(path)
