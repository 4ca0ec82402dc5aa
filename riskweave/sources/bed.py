"""Binary genotype files (.bed with .bim and .fam) as a Spark data source, to read and to write.

spark.read.format("bed").load(path): path is the prefix of one fileset, or a folder that save() has written. Variants are cut into ranges, each read
by one task; two bits a genotype become dosages of the first allele, zeros left out. Filters on snp and iid pick the bytes that are read.

save(genotype, people, path): a folder of filesets, each a range of variants and a chunk of people, and a list of them that is written last:
what a failed task has left isn't on it. Paths are addresses that pyarrow's file systems open (s3, hdfs, gs, file), or paths that every executor mounts.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, In, InputPartition, WriterCommitMessage

from .shared import written

#: First three bytes of a file in variant-major order. Fixed value of the format.
MAGIC = b"\x6c\x1b\x01"
#: Dosage by two-bit code; -1 stands for missing. Fixed values of the format.
CODES = np.array([2, -1, 1, 0], np.int8)
#: Variants that a task reads or a fileset has, about; people of a chunk on average, and the bits of a plane that holds one.
VARIANTS_IN_PART, PEOPLE, BITS = 2048, 30_000, 32_768
#: The list of a folder's filesets.
LIST = "_filesets"


def system_of(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path.removeprefix("file:"))


def opened(prefix: str, suffix: str):
    """A file of the set, for reading."""
    system, path = system_of(prefix)
    return system.open_input_file(path + suffix)


def second_fields(prefix: str, suffix: str) -> list[str]:
    with opened(prefix, suffix) as f:
        return [line.split()[1].decode() for line in f.read().splitlines()]


class BedSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "bed"

    def schema(self) -> str:
        return "iid string, snp string, dosage int"

    def reader(self, schema) -> DataSourceReader:
        return BedReader(self.options["path"])

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        return BedWriter(self.options["path"])


class BedReader(DataSourceReader):
    def __init__(self, path: str):
        self.path = path.removesuffix(".bed")
        self.only: dict[str, set[str]] = {}

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for f in filters:
            if isinstance(f, EqualTo | In) and f.attribute in (("snp",), ("iid",)):
                wanted = set(f.value) if isinstance(f, In) else {f.value}
                self.only[f.attribute[0]] = self.only.get(f.attribute[0], wanted) & wanted
            else:
                yield f

    def partitions(self) -> list[InputPartition]:
        """(fileset, first variant, names) of each range that has a wanted variant; the names are read once, here."""
        out, wanted = [], self.only.get("snp")
        system, path = system_of(self.path)
        if system.get_file_info(f"{path}/{LIST}").type == fs.FileType.File:
            with system.open_input_file(f"{path}/{LIST}") as f:
                return [InputPartition((f"{self.path}/{x['name']}", 0, None)) for x in map(json.loads, f.read().splitlines())]
        names = second_fields(self.path, ".bim")
        for a in range(0, len(names), VARIANTS_IN_PART):
            part = names[a : a + VARIANTS_IN_PART]
            if wanted is None or wanted & set(part):
                out.append(InputPartition((self.path, a, part)))
        return out

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        prefix, first, names = partition.value
        names = second_fields(prefix, ".bim") if names is None else names
        variants = [k for k, n in enumerate(names) if n in self.only.get("snp", {n})]
        if not variants:
            return
        everybody = second_fields(prefix, ".fam")
        people = np.array([k for k, p in enumerate(everybody) if p in self.only.get("iid", {p})], int)
        width, ids = -(-len(everybody) // 4), pa.array(everybody)
        with opened(prefix, ".bed") as f:
            if f.read(3) != MAGIC:
                raise ValueError("not a variant-major .bed file")
            for k in variants:
                f.seek(3 + (first + k) * width)
                raw = np.frombuffer(f.read(width), np.uint8)
                dosage = CODES[(raw[people // 4] >> (people % 4 * 2)) & 3]
                at = np.flatnonzero(dosage)
                if len(at):
                    yield pa.RecordBatch.from_arrays([ids.take(pa.array(people[at])), pa.array([names[k]] * len(at)), pa.array(dosage[at].astype(np.int32), mask=dosage[at] < 0)], names=["iid", "snp", "dosage"])


@dataclass
class Filesets(WriterCommitMessage):
    """What a task has written."""

    found: list[dict]


def two_bits(one: bytes | None, two: bytes | None, none: bytes | None, people: int) -> bytes:
    """A variant's row of a .bed file from the planes of carriers of one allele, of two, and of people without a call."""
    codes = np.full(-(-people // 4) * 4, 3, np.uint8)  # 3: no allele; 2: one; 1: no call; 0: two
    for plane, less in ((one, 1), (two, 3), (none, 2)):
        if plane:
            codes[:people] -= less * np.unpackbits(np.frombuffer(plane, np.uint8), count=people, bitorder="little")
    codes[people:] = 0
    return (codes.reshape(-1, 4) << np.array([0, 2, 4, 6], np.uint8)).sum(1).astype(np.uint8).tobytes()


class BedWriter(DataSourceArrowWriter):
    """Rows come sorted by part, chunk and place; the first of each part and chunk has the chunk's people."""

    def __init__(self, path: str):
        self.path = path

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Filesets:
        system, path = system_of(self.path)
        system.create_dir(path, recursive=True)
        found, bed, bim = [], None, []

        def finish() -> None:
            if bed:
                bed.close()
                for suffix, text in ((".bim", "".join(bim)), (".fam", fam)):
                    with system.open_output_stream(f"{path}/{found[-1]['name']}{suffix}") as f:
                        f.write(text.encode())
                found[-1]["variants"] = len(bim)

        for batch in iterator:
            for r in batch.to_pylist():
                if r["fam"] is not None:
                    finish()
                    found.append({"name": f"part-{r['part']:05}-{r['chunk']:05}-{uuid.uuid4().hex[:12]}", "part": r["part"], "chunk": r["chunk"], "people": r["people"]})
                    bed, bim, fam = system.open_output_stream(f"{path}/{found[-1]['name']}.bed"), [], r["fam"]
                    bed.write(MAGIC)
                else:
                    bed.write(two_bits(r["one"], r["two"], r["none"], found[-1]["people"]))
                    bim.append(f"{r['line']}\n")
        finish()
        return Filesets(found)

    def commit(self, messages: list[Filesets | None]) -> None:
        system, path = system_of(self.path)
        system.create_dir(path, recursive=True)
        every = sorted((x for m in messages if m for x in m.found), key=lambda x: (x["part"], x["chunk"]))
        with system.open_output_stream(f"{path}/{LIST}") as f:
            f.write("".join(json.dumps(x) + "\n" for x in every).encode())

    def abort(self, messages: list[Filesets | None]) -> None:
        system, path = system_of(self.path)
        for x in (x for m in messages if m for x in m.found):
            for suffix in (".bed", ".bim", ".fam"):
                if system.get_file_info(f"{path}/{x['name']}{suffix}").type == fs.FileType.File:
                    system.delete_file(f"{path}/{x['name']}{suffix}")


def register(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(BedSource)


def save(genotype: DataFrame, people: DataFrame, path: str, variants: DataFrame | None = None) -> None:
    """Writes (iid, snp, dosage), no row is dosage 0, a null is no call, as filesets of people (iid) and variants (snp, in their order; else those that occur).

    Bits are set where the rows are grouped; a task holds a row of a variant and the names of a chunk of people. Ranges of variants are in
    their order, people are dealt to chunks by a hash.
    """
    spark = genotype.sparkSession
    register(spark)
    lots = max(1, -(-people.count() // PEOPLE))
    dealt = people.select("iid", F.pmod(F.xxhash64("iid"), F.lit(lots)).cast("int").alias("lot"))
    place = F.row_number().over(Window.partitionBy("lot").orderBy("iid")) - 1
    placed = dealt.withColumn("place", place).select("iid", (F.col("lot") + lots * F.floor(F.col("place") / BITS)).cast("int").alias("chunk"), (F.col("place") % BITS).alias("bit"))
    placed = written(placed, "bed-people")
    line = F.concat(F.col("iid").cast("string"), F.lit(" "), F.col("iid").cast("string"), F.lit(" 0 0 0 -9\n"))
    chunks = placed.groupBy("chunk").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("bit", line.alias("line")))), lambda x: x["line"]), "").alias("fam"), F.count("*").cast("int").alias("people"))
    chunks = written(chunks, "bed-chunks")

    names = (genotype if variants is None else variants).select("snp").distinct()
    ranges = max(1, -(-names.count() // VARIANTS_IN_PART))
    ranged = written(names.repartitionByRange(ranges, "snp").withColumn("part", F.spark_partition_id()), "bed-variants")
    ranged = ranged.withColumn("nth", F.row_number().over(Window.partitionBy("part").orderBy("snp")))
    ranged = ranged.withColumn("line", F.concat_ws(" ", F.lit("1"), F.col("snp").cast("string"), F.lit("0"), (F.col("part").cast("long") * 2 * VARIANTS_IN_PART * 1000 + F.col("nth")).cast("string"), F.lit("A"), F.lit("G")))

    d, bits = F.col("dosage"), lambda keep: F.bitmap_construct_agg(F.when(keep, F.col("bit")))
    planes = genotype.filter(d.isNull() | (d > 0)).join(placed, "iid").groupBy("snp", "chunk").agg(bits(d == 1).alias("one"), bits(d >= 2).alias("two"), bits(d.isNull()).alias("none"))
    numbers = sorted(r["chunk"] for r in chunks.select("chunk").collect())  # one for each 30,000 people
    every = ranged.withColumn("chunk", F.explode(F.array(*map(F.lit, numbers)).cast("array<int>")))  # the format has a row for each variant and chunk
    rows = every.join(planes, ["snp", "chunk"], "left").select("part", "chunk", "nth", "line", "one", "two", "none", F.lit(None).cast("string").alias("fam"), F.lit(None).cast("int").alias("people"))
    none = F.lit(None)
    heads = ranged.groupBy("part").agg(F.lit(numbers).cast("array<int>").alias("chunks")).select("part", F.explode("chunks").alias("chunk")).join(chunks, "chunk").select("part", "chunk", F.lit(0).alias("nth"), none.cast("string").alias("line"), *(none.cast("binary").alias(c) for c in ("one", "two", "none")), "fam", "people")
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    out = rows.unionByName(heads).repartition(tasks, "part", "chunk").sortWithinPartitions("part", "chunk", "nth")
    out.write.format("bed").mode("append").save(path)


def write_fileset(prefix: str, people: list[str], variants: list[str], dosages: np.ndarray) -> None:
    """One small fileset from an array; dosages: (variants, people) of 0, 1, 2 or -1."""
    system, path = system_of(prefix)
    plane = lambda x: np.packbits(x, bitorder="little").tobytes()
    parts = {
        ".bed": MAGIC + b"".join(two_bits(plane(row == 1), plane(row == 2), plane(row == -1), len(people)) for row in dosages), ".bim": "".join(f"1 {v} 0 {i + 1} A G\n" for i, v in enumerate(variants)).encode(),
        ".fam": "".join(f"{p} {p} 0 0 0 -9\n" for p in people).encode(),
    }
    for suffix, content in parts.items():
        with system.open_output_stream(path + suffix) as f:
            f.write(content)
