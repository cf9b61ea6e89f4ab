"""Operator 5: token ids in a content-addressed store.

Layout under a store's path, all Parquet:
  staged/kind=0/ key (BLAKE2b-128 of data), data (ids, little-endian, `width` bytes each): each distinct chunk once
  recipes/       part, seq, doc_id, n_tokens, digests (a document's chunk digests in a row), root: in ascending doc_id order
  manifest/      part, first_id, last_id, n_docs, n_ids, root: a Merkle tree over the part's documents, whose leaves are
            hashes over id, length and chunk digests
  top/           root: of the tree over the manifest's rows, so that it vouches for every id, every place and every part
"""

from __future__ import annotations

import functools
import hashlib
import zlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .chunks import encoder
from .common import dropped, text_slices

DIGEST = 16
#: Chunks end where the rolling hash of the last 16 ids has zeros under MASK (one place in 512), within these lengths.
MASK, LEAST, MOST = 0x1FF << 15, 64, 4096
#: A node of the Merkle trees has so many bits of children.
FAN_BITS = 8
#: Texts of about so many bytes are encoded at once.
ENCODE_BYTES = 4 << 20
CHUNKS = "kind int, key binary, data binary"
STAGED = "kind int, key binary, data binary, doc_id {id}, n_tokens bigint"
CRC_POLYNOMIAL = np.uint32(0xEDB88320)


def digest_of(data: bytes | memoryview) -> bytes:
    return hashlib.blake2b(data, digest_size=DIGEST).digest()


@functools.lru_cache(maxsize=1)
def gear(size: int = 1 << 17) -> np.ndarray:
    """A fixed pseudo-random number per id."""
    return np.random.default_rng(20240229).integers(0, 1 << 32, size, np.uint32)


def marks(ids: np.ndarray) -> np.ndarray:
    """Places after which a chunk may end. The hash of the 16 ids before a place is summed by doubling: each step joins two
    neighbouring runs, the older shifted. Equal runs of ids are cut alike wherever they stand; no chunk is shorter than
    16, so several streams may follow each other."""
    h = gear()[ids]
    for step in (1, 2, 4, 8):
        shifted = np.zeros_like(h)
        shifted[step:] = h[:-step] << np.uint32(step)
        h += shifted
    return np.flatnonzero((h & np.uint32(MASK)) == 0) + 1


def cuts(places: list[int], start: int, stop: int) -> list[int]:
    """Ends of the chunks of the stream from start to stop, given the places in it where they may end."""
    out, last = [], start
    for end in places:
        while end - last > MOST:
            last += MOST
            out.append(last)
        if end - last >= LEAST:
            out.append(end)
            last = end
    while stop - last > MOST:
        last += MOST
        out.append(last)
    if last < stop:
        out.append(stop)
    return out


def streams(enc, column: pa.Array, texts: list[str], end_id: int, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(ids of all texts in a row, each followed by end_id; where each text's end)."""
    codes, ends, table, bounds = enc.coded(column, texts, width)
    codes = np.insert(codes, ends, len(bounds) - 1)  # one more code: the end
    table = np.append(table, np.array([end_id], table.dtype))
    starts, n = bounds[codes], np.diff(np.append(bounds, len(table)))[codes]
    through = np.cumsum(n)
    ids = table[np.repeat(starts - through + n, n) + np.arange(int(through[-1]) if len(through) else 0)]
    return ids, through[ends + np.arange(len(ends))]


def _stage(batches: Iterator[pa.RecordBatch], path: str, end_id: int, width: int) -> Iterator[pa.RecordBatch]:
    enc = encoder(path, "store")
    seen: set[bytes] = set()  # a chunk leaves a task once, unless the set was emptied meanwhile
    serial = 0
    for part, texts in text_slices(batches, "text", ENCODE_BYTES):
        ids, ends = streams(enc, pc.fill_null(part.column("text"), ""), texts, end_id, width)
        places, data = marks(ids), memoryview(ids.tobytes())
        of_doc = np.split(places, np.searchsorted(places, ends, "right"))
        pieces: tuple[list, list] = ([], [])
        recipes, keys, start = [], [], 0
        if len(seen) > 500_000:
            seen.clear()
        for doc_id, mine, stop in zip(part.column("doc_id").to_pylist(), of_doc, ends.tolist(), strict=False):
            recipe = []
            for e in cuts(mine.tolist(), start, stop):
                piece = data[start * width : e * width]
                recipe.append(d := digest_of(piece))
                if d not in seen:
                    seen.add(d)
                    pieces[0].append(d)
                    pieces[1].append(piece)
                start = e
            serial += 1
            keys.append(digest_of(f"{doc_id}/{serial}".encode()))
            recipes.append(b"".join(recipe))
        kind = part.schema.field("doc_id").type
        n = len(pieces[0])
        yield pa.RecordBatch.from_arrays([pa.array(np.zeros(n), pa.int32()), pa.array(pieces[0], pa.binary()), pa.array(pieces[1], pa.binary()), pa.nulls(n, kind), pa.nulls(n, pa.int64())], ["kind", "key", "data", "doc_id", "n_tokens"])
        yield pa.RecordBatch.from_arrays([pa.array(np.ones(len(keys)), pa.int32()), pa.array(keys, pa.binary()), pa.array(recipes, pa.binary()), part.column("doc_id"), pa.array(np.diff(ends, prepend=0), pa.int64())], ["kind", "key", "data", "doc_id", "n_tokens"])


def _once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All rows of a digest are in one partition: the first stays."""
    seen: set[bytes] = set()
    for batch in batches:
        keep = []
        for kind, key in zip(batch.column("kind").to_pylist(), batch.column("key").to_pylist(), strict=True):
            keep.append(kind == 1 or key not in seen)
            if kind == 0:
                seen.add(key)
        yield batch.filter(pa.array(keep, pa.bool_()))


def write_store(docs: DataFrame, path: str, tokenizer: str, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Encodes every text, null as empty, ends it with end_id, and writes a store to path.

    One shuffle moves the ids, of chunks that are new to their task, so a chunk that a third of all documents hold
    reaches its partition at most once per task. Recipes are a few hundredths of the ids; they are put in order by ranges
    of (doc_id, recipe), which parts rows that share an id."""
    spark = docs.sparkSession
    width = 2 if encoder(tokenizer, "store").model.get_vocab_size() < 1 << 16 and end_id < 1 << 16 else 4
    narrow = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    schema = STAGED.format(id=narrow.schema["doc_id"].dataType.simpleString())
    staged = narrow.mapInArrow(partial(_stage, path=tokenizer, end_id=end_id, width=width), schema)
    staged.repartition("key").mapInArrow(_once, schema).write.partitionBy("kind").option("compression", "zstd").parquet(f"{path}/staged")
    rows = spark.read.schema(schema).parquet(f"{path}/staged").filter("kind = 1")
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows.select("doc_id", "n_tokens", F.col("data").alias("digests")).repartitionByRange(n, "doc_id", "digests").sortWithinPartitions("doc_id", "digests").select(
        F.spark_partition_id().alias("part"), F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)).alias("seq"), "doc_id", "n_tokens", "digests",
    ).write.parquet(f"{path}/recipes")
    manifest_of(spark.read.parquet(f"{path}/recipes")).write.parquet(f"{path}/manifest")
    top_of(spark.read.parquet(f"{path}/manifest")).write.parquet(f"{path}/top")
    spark.createDataFrame([(width,)], "width int").write.parquet(f"{path}/format")


def tree_roots(leaves: DataFrame, key: list[str]) -> DataFrame:
    """key, root of the Merkle trees over leaves (key, seq, root) in order of seq: a node hashes at most 2^FAN_BITS below
    it, so no group is larger, and each level is a fraction of the one before."""
    highest = leaves.agg(F.max("seq")).first()[0] or 0
    while True:
        children = F.array_sort(F.collect_list(F.struct("seq", "root")))
        leaves = leaves.groupBy(*key, F.shiftright("seq", FAN_BITS).alias("_up")).agg(F.sha2(F.array_join(F.transform(children, lambda x: x.root), ""), 256).alias("root")).withColumnRenamed("_up", "seq")
        highest >>= FAN_BITS
        if not highest:
            return leaves.select(*key, "root")


def _leaf(*columns: str):
    return F.sha2(F.to_json(F.struct(*columns)), 256).alias("root")


def manifest_of(recipes: DataFrame) -> DataFrame:
    per = recipes.groupBy("part").agg(F.min("doc_id").alias("first_id"), F.max("doc_id").alias("last_id"), F.count("*").alias("n_docs"), F.sum("n_tokens").alias("n_ids"))
    return per.join(tree_roots(recipes.select("part", "seq", _leaf("doc_id", "n_tokens", "digests")), ["part"]), "part")


def top_of(manifest: DataFrame) -> DataFrame:
    """root: one row; parts are leaves in their order, an empty store has none."""
    leaves = manifest.select(F.lit(0).alias("all"), F.col("part").cast("long").alias("seq"), _leaf("part", "first_id", "last_id", "n_docs", "n_ids", "root"))
    return tree_roots(leaves, ["all"]).select("root")


def crc_times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Products of two polynomials modulo that of CRC-32, bits reflected, element by element."""
    out = np.zeros(np.broadcast(a, b).shape, np.uint32)
    for bit in range(31, -1, -1):
        out ^= b * ((a >> np.uint32(bit)) & np.uint32(1))
        b = (b >> np.uint32(1)) ^ (CRC_POLYNOMIAL * (b & np.uint32(1)))
    return out


@functools.lru_cache(maxsize=1)
def crc_powers() -> np.ndarray:
    """x to the power 8 * 2^k."""
    out = [np.array(0x00800000, np.uint32)]
    for _ in range(40):
        out.append(crc_times(out[-1], out[-1]))
    return np.array(out, np.uint32)


def crc_before(crc: np.ndarray, n_bytes: np.ndarray) -> np.ndarray:
    """What byte strings with these CRCs add to that of a longer one in which so many bytes follow them; a string's CRC is
    the exclusive or of what its pieces add."""
    for k, power in enumerate(crc_powers()):
        on = (n_bytes >> k) & 1 == 1
        if on.any():
            crc[on] = crc_times(crc[on], power)
    return crc


def _read_chunks(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        crc, n = [], []
        for key, data in zip(batch.column("key").to_pylist(), batch.column("data").to_pylist(), strict=True):
            if digest_of(data) != key:
                raise ValueError(f"chunk {key.hex()} does not hold what its digest says")
            ids = np.frombuffer(data, f"<u{width}")
            crc.append(zlib.crc32(ids.astype("<u4").tobytes()))
            n.append(len(ids))
        yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array(crc, pa.int64()), pa.array(n, pa.int64())], ["key", "crc", "n"])


def _join_crcs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        pieces = batch.column("pieces")
        sizes = pc.list_value_length(pieces).to_numpy(zero_copy_only=False)
        flat = pieces.flatten()
        row = np.repeat(np.arange(len(sizes)), sizes)
        pos, crc, n = (flat.field(k).to_numpy(zero_copy_only=False) for k in ("pos", "crc", "n"))
        order = np.lexsort((pos, row))
        row, crc, n = row[order], crc[order].astype(np.uint32), n[order]
        through = np.cumsum(n)
        ends = np.cumsum(sizes)
        total = np.diff(np.concatenate([[0], through[ends - 1]])) if len(ends) else through
        after = 4 * (np.repeat(through[ends - 1], sizes) - through) if len(ends) else through
        joined = np.bitwise_xor.reduceat(crc_before(crc, after), ends - sizes) if len(ends) else crc
        yield pa.RecordBatch.from_arrays([batch.column("part"), batch.column("seq"), pa.array(total, pa.int64()), pa.array(joined.astype(np.int64))], ["part", "seq", "n_read", "ids_crc32"])


def verified(recipes: DataFrame, manifest: DataFrame, top: DataFrame) -> None:
    """Raises unless the manifest is that of the recipes, in every field, and the top root that of the manifest."""
    have, want = manifest_of(recipes).select(sorted(manifest.columns)), manifest.select(sorted(manifest.columns))
    same_top = top_of(manifest).exceptAll(top).limit(1).count() + top.exceptAll(top_of(manifest)).limit(1).count()
    if same_top or have.exceptAll(want).limit(1).count() + want.exceptAll(have).limit(1).count():
        raise ValueError("the recipes differ from the manifest, or the manifest from its root")


def verify_manifest(spark: SparkSession, path: str) -> None:
    verified(*(spark.read.parquet(f"{path}/{t}") for t in ("recipes", "manifest", "top")))


def read_digests(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of a store's documents, from its files.

    Every chunk is read, held against its digest and summed up as a CRC once; a document's CRC follows from those of its
    chunks, so no ids are shuffled. Starts are running sums inside a part, after the manifest's totals of those before."""
    verify_manifest(spark, path)
    width = spark.read.parquet(f"{path}/format").first()[0]
    chunks = spark.read.schema(CHUNKS).parquet(f"{path}/staged").filter("kind = 0").select("key", "data").mapInArrow(partial(_read_chunks, width=width), "key binary, crc bigint, n bigint")
    recipes = spark.read.parquet(f"{path}/recipes")
    pieces = recipes.select("part", "seq", F.posexplode(F.expr(f"transform(sequence(0, cast(length(digests) / {DIGEST} as int) - 1), i -> substring(digests, i * {DIGEST} + 1, {DIGEST}))")).alias("pos", "key"))
    joined = pieces.join(chunks, "key").groupBy("part", "seq").agg(F.collect_list(F.struct("pos", "crc", "n")).alias("pieces")).mapInArrow(_join_crcs, "part int, seq bigint, n_read bigint, ids_crc32 bigint")
    offsets = spark.read.parquet(f"{path}/manifest").select("part", F.coalesce(F.sum("n_ids").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    inside = F.coalesce(F.sum("n_tokens").over(W.partitionBy("part").orderBy("seq").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    starts = recipes.select("part", "seq", "doc_id", "n_tokens").join(F.broadcast(offsets), "part").withColumn("start", F.col("before") + inside)  # a row per part
    checked = F.when(F.col("n_read") == F.col("n_tokens"), F.col("n_read")).otherwise(F.raise_error(F.lit("a document's ids are not whole")).cast("long"))
    return starts.join(joined, ["part", "seq"]).select("doc_id", "start", checked.alias("n_tokens"), "ids_crc32")


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, ids (array<int>) rebuilt from the store."""
    width = spark.read.parquet(f"{path}/format").first()[0]
    chunks = spark.read.schema(CHUNKS).parquet(f"{path}/staged").filter("kind = 0").select("key", "data")
    recipes = spark.read.parquet(f"{path}/recipes")
    pieces = recipes.select("part", "seq", "doc_id", F.posexplode(F.expr(f"transform(sequence(0, cast(length(digests) / {DIGEST} as int) - 1), i -> substring(digests, i * {DIGEST} + 1, {DIGEST}))")).alias("pos", "key"))
    whole = pieces.join(chunks, "key").groupBy("part", "seq", "doc_id").agg(F.array_sort(F.collect_list(F.struct("pos", "data"))).alias("p"))

    def rebuilt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = [np.frombuffer(b"".join(x["data"] for x in p), f"<u{width}").astype(np.int32) for p in b.column("p").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(ids, pa.list_(pa.int32()))], ["doc_id", "ids"])

    return whole.select("doc_id", "p").mapInArrow(rebuilt, f"doc_id {recipes.schema['doc_id'].dataType.simpleString()}, ids array<int>")


def drop_store(spark: SparkSession, path: str) -> None:
    dropped(spark, path)
