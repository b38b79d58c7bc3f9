"""Problem 5: check new batches against all history by content-defined chunking.

A record's content is its address, written one way, and its text, if it has one. A rolling
hash over the bytes sets chunk boundaries, so equal stretches give equal chunks wherever
they lie. A persistent table maps each chunk to the accepted records that have it; looking
up a record's chunks leads to earlier records, and the bytes of the chunks that two records
share decide: a record repeats the first accepted one that covers enough of its address or of
its text. An exact check of organisation, year, volume and document number (the kin) follows.
The chunks of records that repeat nothing are appended.

Only records of equal kin can repeat each other, so chunks are looked up with their kin. Not
every chunk has to be looked up: whoever covers a share of a record has one of any chunks that
make up more than the rest. The least frequent such chunks are the probes. Addresses have to
cover each other, so probes in one common order meet probes. Pairs that meet are compared by
their whole lists of chunks. Records whose chunks, kin and organisation are all equal are one
class, looked up once; its later members repeat what the first one repeats, or the first.

Defined results: a null address has no chunks; such a row repeats one whose organisation is
written alike and whose text covers it, with an address or not; a row with neither address nor
text repeats nothing; rows with equal ids are one record; null ids are left out. A chunk that
comes several times in a record counts once. Earlier means accepted by an earlier call, within a
call the order of ids.
"""

from __future__ import annotations

import os
import re
import time
import unicodedata
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from functools import lru_cache
from urllib.parse import unquote

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docmill.llm.common import materialise, spread, table
from docmill.session import place

#: Coverage from which a record counts as covered by an earlier one: addresses in both directions, texts of the later one.
COVER_ADDRESS, COVER_TEXT = 0.9, 0.8
#: Least coverage of addresses beside a covering text, where both have one.
BESIDE_TEXT = 0.5
#: A class of more than one row in this many is frequent; so fewer than SHARE classes are.
SHARE = 2000
#: Most frequent chunks that are sent to all tasks to choose probes; results do not depend on it.
COMMON = 10_000
#: Folders of the chunk table, by chunk; a batch opens those of its probes.
PREFIXES = 256
#: Bits of a chunk's number that hold its length.
_BITS = 13
_LENGTH = (1 << _BITS) - 1

_GEAR = np.random.default_rng(11).integers(0, 1 << 63, 256, dtype=np.uint64)


def boundaries(data: bytes, window: int, bits: int, low: int, high: int) -> list[int]:
    """Ends of the chunks of data: where the rolling hash of the last `window` bytes ends in zeros.

    The hash of a window is built by doubling, with whole-array operations; `low` and
    `high` are the least and greatest chunk lengths.
    """
    n = len(data)
    if n == 0:
        return []
    h = _GEAR[np.frombuffer(data, np.uint8)]
    w = 1
    while w < window:
        h[w:] = h[w:] + (h[:-w] << np.uint64(w))
        w *= 2
    ends, last = [], 0
    top = np.uint64(64 - bits)
    for p in (np.flatnonzero((h >> top) == 0) + 1).tolist():
        while p - last > high:
            last += high
            ends.append(last)
        if p - last >= low:
            last = p
            ends.append(p)
    while n - last > high:
        last += high
        ends.append(last)
    if last < n:
        ends.append(n)
    return ends


def chunks(data: bytes, window: int, bits: int, low: int, high: int) -> list[tuple[int, int]]:
    """(number, length) of each chunk; the number is a signed 64-bit integer, a hash whose low bits are the length."""
    out, start = [], 0
    for end in boundaries(data, window, bits, low, high):
        h = xxhash.xxh3_64_intdigest(data[start:end]) & ~_LENGTH | (end - start)
        out.append((h - (1 << 64) if h >> 63 else h, end - start))
        start = end
    return out


def _signed(data: bytes) -> int:
    h = xxhash.xxh3_64_intdigest(data)
    return h - (1 << 64) if h >> 63 else h


def address_chunks(data: bytes) -> list[tuple[int, int]]:
    return chunks(data, 4, 2, 4, 24)


def text_chunks(data: bytes) -> list[tuple[int, int]]:
    return chunks(data, 32, 9, 128, 4096)


def plain(text: str) -> str:
    """Lower-case letters and digits without accents."""
    return "".join(c for c in unicodedata.normalize("NFKD", text.casefold()) if c.isalnum())


#: Path parts that name a view or a place of a copy, not a document.
_VIEWS = {"view", "download", "print", "preview"}
_MARKS = {"web", "final", "copy", "accessible", "print", "online", "lowres", "screen", "download"}
_LOOSE = re.compile(r"(?<!\d)-|-(?!\d)")
_SCHEME = re.compile(r"(?:https?|ftp):/+")


def canonical(address: str) -> tuple[str, str]:
    """(host, path) of an address, written one way.

    An address inside another (an archive's or a mirror's copy) stands for itself;
    scheme, port, `www`, escapes, case, doubled slashes, fragment, tracking
    parameters, file endings and marks of a copy go; separators become one. The last
    two parts of the path count, since copies lie under other folders.
    """
    text = address.replace("+", " ")
    for _ in range(4):
        new = unquote(text)
        if new == text:
            break
        text = new
    text = text.strip().strip("<>").strip().casefold()
    starts = list(_SCHEME.finditer(text))
    if starts:
        text = text[starts[-1].end() :]
    text = text.split("#")[0]
    body, _, query = text.replace("&", "?", 1).partition("?") if "?" not in text else text.partition("?")
    number = re.search(r"(?:^|[?&])(?:doc|id|file|document)=(\w+)", query)
    parts = [p.strip() for p in body.split("/")]
    parts = [p for p in parts if p not in ("", ".")]
    if not parts:
        return "", ""
    host = re.sub(r":\d+$", "", parts[0]).removeprefix("www.")
    parts = parts[1:]
    if len(parts) > 1 and parts[-1] in _VIEWS:
        parts.pop()
    if parts:
        name = re.sub(r"(?:\.(?:pdf|html?))+$", "", parts[-1])
        parts[-1] = re.sub(r"\s*\(\d+\)$", "", name)
    path = [[t for t in re.split(r"[\s_\-.,]+", p) if t] for p in parts[-2:]]
    if path:
        last = path[-1]
        numbered = any(any(c.isdigit() for c in t) for t in last)
        while len(last) > 1 and last[-1].isalpha() and (numbered or last[-1] in _MARKS):
            last.pop()
    return host, "/".join("-".join(p) for p in path) + (f"?{number[1]}" if number else "")


@lru_cache(maxsize=100_000)
def identity(org: str | None, address: str | None) -> tuple[str, str, str]:
    """(content, kin, host): content is what of an address is chunked; kin its organisation and numbers.

    Separators count between figures only, so names written with and without them are one.
    """
    if not address or not address.strip():
        return "", "org:" + plain(org) if org and org.strip() else "", ""
    host, path = canonical(address)
    name = plain(host)
    return f"{name} {_LOOSE.sub('', path)}", name + " " + " ".join(sorted(re.findall(r"\d+", path))), name


_RECORD = (
    "id long, arrived long, digest long, kin long, named long, own_address int, own_text int, address array<long>, text array<long>"
)


def records(df: DataFrame, key: str, org: str, address: str, text: str | None = None, arrived: int = 0) -> DataFrame:
    """One row per record with content: numbers of its chunks, each once, and their bytes.

    `kin` and `named` are digests of the exact check's fields and of the organisation as
    written, null without one; `digest` is one of all its chunks and both.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cols: list[list] = [[] for _ in range(9)]
            texts = batch.column(3).to_pylist() if text else [None] * batch.num_rows
            for k, o, a, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), texts):
                who, kin, _ = identity(o, a)
                body = t.encode("utf-8", "replace") if t else b""
                mine = dict.fromkeys(h for h, _ in address_chunks(who.encode()))
                words = dict.fromkeys(h for h, _ in text_chunks(body)) if body.strip() else {}
                if not mine and not words:
                    continue
                name = plain(o) if o and o.strip() else None
                whole = np.array([len(mine), *mine, *words], np.int64).tobytes() + repr((kin, name)).encode()
                row = (
                    k, arrived, _signed(whole), _signed(kin.encode()), None if name is None else _signed(name.encode()),
                    sum(h & _LENGTH for h in mine), sum(h & _LENGTH for h in words), list(mine), list(words),
                )
                for c, v in zip(cols, row):
                    c.append(v)
            types = [pa.int64()] * 5 + [pa.int32()] * 2 + [pa.list_(pa.int64())] * 2
            names = [c.split()[0] for c in _RECORD.split(", ")]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names)

    cols = [F.col(key).cast("long").alias("id"), F.col(org), F.col(address)] + ([F.col(text)] if text else [])
    return df.filter(F.col(key).isNotNull()).select(*cols).mapInArrow(run, _RECORD)


def _before(met: DataFrame) -> DataFrame:
    """Pairs whose holder came first."""
    earlier = (F.col("h_arrived") < F.col("arrived")) | (F.col("h_arrived") == F.col("arrived")) & (F.col("holder") < F.col("id"))
    return met.filter(earlier & (F.col("holder") != F.col("id")))


def classes(held: DataFrame) -> DataFrame:
    """(id, of): each record that is not the first of its class, with the first one."""
    rows = held.select("digest", "arrived", "id")
    first = rows.groupBy("digest").agg(F.min(F.struct("arrived", "id")).alias("f"), F.count(F.lit(1)).alias("rows"))
    first = first.filter("rows > 1").select("digest", F.col("f.id").alias("of"), "rows")
    limit = max(1000, held.count() // SHARE)  # every row is in one class, so fewer than SHARE are above it
    frequent = F.broadcast(first.filter(F.col("rows") > limit).select("digest", "of"))
    hot = rows.join(frequent, "digest")
    cold = rows.join(frequent, "digest", "left_anti").join(first.filter(F.col("rows") <= limit), "digest")
    return hot.select("id", "of").unionByName(cold.select("id", "of")).filter("id != of").distinct()


def probes(firsts: DataFrame, cover: float = COVER_ADDRESS, most: int = COMMON) -> DataFrame:
    """(id, arrived, chunk, kin): the chunks of each address, least frequent first, that a coverer cannot all lack.

    One order for all records: by frequency if a chunk is among the `most` frequent ones, then by number.
    """
    every = firsts.select(F.explode("address").alias("chunk")).groupBy("chunk").agg(F.count(F.lit(1)).alias("n"))
    top = {r.chunk: r.n for r in every.filter("n > 1").orderBy(F.desc("n"), "chunk").limit(most).collect()}
    shared = firsts.sparkSession.sparkContext.broadcast(top)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        often = shared.value
        for batch in batches:
            cols: list[list] = [[], [], [], []]
            for k, at, kin, own, mine in zip(*(c.to_pylist() for c in batch.columns)):
                left = own * (1 - cover) + 1  # a byte more for rounding
                for h in sorted(mine, key=lambda h: (often.get(h, 0), h)):
                    for c, v in zip(cols, (k, at, h, kin)):
                        c.append(v)
                    left -= h & _LENGTH
                    if left < 0:
                        break
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], ["id", "arrived", "chunk", "kin"])

    placed = firsts.filter("own_address > 0").select("id", "arrived", "kin", "own_address", "address")
    return placed.mapInArrow(run, "id long, arrived long, chunk long, kin long")


def address_pairs(own: DataFrame, held: DataFrame) -> DataFrame:
    """(id, holder) of records whose addresses can cover each other."""
    mine = materialise(probes(held), "p5-probes")
    theirs = mine.select("chunk", "kin", F.col("id").alias("holder"), F.col("arrived").alias("h_arrived"))
    return _before(mine.join(own.select("id"), "id", "left_semi").join(theirs, ["chunk", "kin"])).select("id", "holder").distinct()


def text_pairs(own: DataFrame, held: DataFrame) -> DataFrame:
    """(id, holder) of each record with all earlier holders that can cover its text.

    Those of equal kin, and where one of the two has no address those of equal organisation.
    """
    rows = own.select("id", "arrived", "kin", "named", "own_text", (F.col("own_address") > 0).alias("placed"), F.explode("text").alias("chunk"))
    holders = held.select(
        F.col("id").alias("holder"), F.col("arrived").alias("h_arrived"), "kin", "named", (F.col("own_address") > 0).alias("placed"), F.explode("text").alias("chunk")
    )
    named = F.col("named").alias("kin")
    mine, theirs = ["id", "arrived", "own_text", "chunk"], ["holder", "h_arrived", "chunk"]
    sides = (
        (rows.select(*mine, "kin"), holders.select(*theirs, "kin")),
        (rows.filter("NOT placed").select(*mine, named), holders.filter("placed").select(*theirs, named)),
        (rows.filter("placed").select(*mine, named), holders.filter("NOT placed").select(*theirs, named)),
    )
    a, b, c = (_rarest_met(r, h) for r, h in sides)
    return a.unionByName(b).unionByName(c).distinct()


def _rarest_met(rows: DataFrame, held: DataFrame) -> DataFrame:
    counts = held.groupBy("chunk", "kin").agg(F.count(F.lit(1)).alias("held"))
    rare = rows.join(counts, ["chunk", "kin"], "left").fillna(0, ["held"])
    before = Window.partitionBy("id").orderBy("held", "chunk").rowsBetween(Window.unboundedPreceding, -1)
    rare = rare.withColumn("before", F.coalesce(F.sum(F.col("chunk").bitwiseAND(F.lit(_LENGTH))).over(before), F.lit(0)))
    # A holder without any of these chunks lacks more than 1 - COVER_TEXT of the text; a byte more for rounding.
    rare = rare.filter((F.col("before") <= F.col("own_text") * (1 - COVER_TEXT) + 1) & (F.col("held") > 0))
    return _before(rare.select("id", "arrived", "chunk", "kin").join(held, ["chunk", "kin"])).select("id", "holder")


def _bytes(both) -> F.Column:
    return F.aggregate(both, F.lit(0).cast("long"), lambda n, h: n + h.bitwiseAND(F.lit(_LENGTH).cast("long")))


def coverage(pairs: DataFrame, own: DataFrame, held: DataFrame) -> DataFrame:
    """(dup_id, first_id, h_arrived, address_cover, text_cover, repeats) of each pair, by all chunks of both."""
    theirs = held.select(*(F.col(c).alias("h_" + c) for c in held.columns))
    met = pairs.join(own, "id").join(theirs, F.col("holder") == F.col("h_id"))
    shared = lambda c: _bytes(F.array_intersect(c, "h_" + c))
    address = shared("address") / F.greatest("own_address", "h_own_address", F.lit(1))
    words = shared("text") / F.greatest("own_text", F.lit(1))
    both = (F.col("own_address") > 0) & (F.col("h_own_address") > 0)
    one = (F.col("own_address") > 0) != (F.col("h_own_address") > 0)
    kin, text = F.col("kin") == F.col("h_kin"), F.col("text_cover") >= COVER_TEXT
    by_address = both & kin & (F.col("address_cover") >= COVER_ADDRESS)
    by_text = text & kin & (~both & ~one | both & (F.col("address_cover") >= BESIDE_TEXT))
    by_name = text & one & F.coalesce(F.col("named") == F.col("h_named"), F.lit(False))
    met = met.withColumns({"address_cover": address, "text_cover": words})
    return met.select(
        F.col("id").alias("dup_id"), F.col("holder").alias("first_id"), "h_arrived", "address_cover", "text_cover", (by_address | by_text | by_name).alias("repeats")
    )


def accepted_first(pairs: DataFrame) -> DataFrame:
    """(dup_id, first_id): each repeating record with the first accepted record that covers it.

    A record is accepted if no accepted earlier one covers it, as if records came one by
    one: those whose coverers are all decided are decided next, until none is left.
    """
    left, done = pairs.select("dup_id", "first_id", "h_arrived"), None
    while True:
        open_ids = left.select(F.col("dup_id").alias("first_id")).distinct()
        sure = left.join(open_ids, "first_id", "left_anti")  # their holders are accepted
        new = sure.groupBy("dup_id").agg(F.min(F.struct("h_arrived", "first_id")).alias("f")).select("dup_id", "f.h_arrived", "f.first_id")
        unsure = left.join(open_ids, "first_id", "left_semi")
        if unsure.isEmpty():
            new = new.select("dup_id", "first_id")
            return new if done is None else done.unionByName(new)
        # An earlier holder than the sure one may still turn out to be accepted: it is asked first.
        surest = new.select("dup_id", F.col("h_arrived").alias("s_arrived"), F.col("first_id").alias("s_first"))
        wait = unsure.join(surest, "dup_id").filter("struct(h_arrived, first_id) < struct(s_arrived, s_first)").select("dup_id")
        new = materialise(new.join(wait, "dup_id", "left_anti").select("dup_id", "first_id"), "p5-new")
        done = new if done is None else done.unionByName(new)
        # What is decided to repeat holds nothing; what has no holder left is accepted.
        left = materialise(left.join(new, "dup_id", "left_anti").join(new.select(F.col("dup_id").alias("first_id")), "first_id", "left_anti").select("dup_id", "first_id", "h_arrived"), "p5-left")
        if left.isEmpty():
            return done


def lookup(own: DataFrame, held: DataFrame, text: bool) -> tuple[DataFrame, DataFrame]:
    """((dup_id, first_id) of what repeats, coverage of all pairs compared); `held` has the records of `own` and earlier ones."""
    copies = materialise(classes(held), "p5-copies")
    firsts = materialise(held.join(copies.select("id"), "id", "left_anti").dropDuplicates(["id"]), "p5-firsts")
    mine = firsts.join(own.select("id"), "id", "left_semi") if own is not held else firsts
    pairs = address_pairs(mine, firsts)
    if text:
        pairs = pairs.unionByName(text_pairs(mine, firsts)).distinct()
    met = materialise(coverage(pairs, mine, firsts), "p5-met")
    found = accepted_first(met.filter("repeats"))
    later = copies if own is held else copies.join(own.select("id"), "id", "left_semi")
    of = later.join(found.withColumnRenamed("dup_id", "of"), "of", "left").select(F.col("id").alias("dup_id"), F.coalesce("first_id", "of").alias("first_id"))
    every = met.select("dup_id", "first_id", "address_cover", "text_cover", "repeats")
    whole = lambda c: F.when(F.col(c) > 0, 1.0).otherwise(0.0)
    same = later.join(firsts.select(F.col("id").alias("of"), "own_address", "own_text"), "of").select(
        F.col("id").alias("dup_id"), F.col("of").alias("first_id"), whole("own_address").alias("address_cover"), whole("own_text").alias("text_cover"), F.lit(True).alias("repeats")
    )
    return found.unionByName(of), every.unionByName(same)


def check_all(df: DataFrame, key: str, org: str, address: str, text: str | None = None) -> tuple[DataFrame, DataFrame]:
    """All batches of a table in one pass: what accepting them one after another in the order of key gives."""
    rows = materialise(records(spread(df), key, org, address, text), "p5-records")
    return lookup(rows, rows, text is not None)


def repeats(checked: tuple[DataFrame, DataFrame]) -> DataFrame:
    return checked[0].select("first_id", "dup_id")


def accept_batch(
    spark: SparkSession, batch: DataFrame, store: str, key: str, org: str, address: str, text: str | None = None, arrived: int | None = None
) -> DataFrame:
    """Check one batch against the chunk table in folder `store` and append the chunks of what is accepted.

    Of the store are read the folders of the chunk table that the batch's chunks fall
    into, and the records found there; never the history's texts. Returns (first_id,
    dup_id) of the rows that repeat an accepted record or an earlier row of the batch.
    `arrived` orders the calls and defaults to the time. A batch that comes again keeps its
    first place, so that running it again changes no result.
    """
    chunk_path, record_path = os.path.join(store, "chunks"), os.path.join(store, "records")
    rows = materialise(records(batch, key, org, address, text, time.time_ns() if arrived is None else arrived), "p5-batch")
    held = rows
    if _exists(spark, record_path):
        stored, table_ = spark.read.schema(_RECORD + ", part int").parquet(record_path), spark.read.parquet(chunk_path)
        mine = materialise(_chunk_rows(rows), "p5-mine")
        opened = [r[0] for r in mine.select("prefix").distinct().collect()]  # at most PREFIXES
        theirs = table_.filter(F.col("prefix").isin(opened)).select("prefix", "chunk", "kin", "named", "holder")
        by_kin = theirs.join(mine.select("prefix", "chunk", "kin").distinct(), ["prefix", "chunk", "kin"], "left_semi")
        by_name = theirs.join(mine.select("prefix", "chunk", "named").distinct(), ["prefix", "chunk", "named"], "left_semi")
        met = by_kin.unionByName(by_name).select(F.col("holder").alias("id")).union(rows.select("id")).distinct()
        met = materialise(met.withColumn("part", F.pmod("id", F.lit(PREFIXES)).cast("int")), "p5-ids")
        parts = [r[0] for r in met.select("part").distinct().collect()]
        old = stored.filter(F.col("part").isin(parts)).join(met, ["part", "id"], "left_semi").select(*rows.columns)
        old = materialise(old.groupBy("id").agg(F.min_by(F.struct(*rows.columns), "arrived").alias("r")).select("r.*"), "p5-old")
        known = old.select("id", F.col("arrived").alias("was"))
        rows = rows.join(known, "id", "left").withColumn("arrived", F.coalesce("was", "arrived")).select(*rows.columns)
        held = materialise(old.join(rows.select("id"), "id", "left_anti").unionByName(rows), "p5-held")
        rows = held.join(rows.select("id"), "id", "left_semi")
    found = materialise(repeats(lookup(rows, held, text is not None)), "p5-found")
    accepted = materialise(rows.join(found.select(F.col("dup_id").alias("id")), "id", "left_anti").dropDuplicates(["id"]), "p5-accepted")
    # Chunks first: what has chunks but no record yet is not met.
    _chunk_rows(accepted).withColumnRenamed("id", "holder").repartition("prefix").write.mode("append").partitionBy("prefix").parquet(chunk_path)
    accepted.withColumn("part", F.pmod("id", F.lit(PREFIXES)).cast("int")).repartition("part").write.mode("append").partitionBy("part").parquet(record_path)
    return found


def _chunk_rows(rows: DataFrame) -> DataFrame:
    every = rows.select("id", "kin", "named", F.explode(F.array_distinct(F.concat("address", "text"))).alias("chunk"))
    return every.withColumn("prefix", F.pmod("chunk", F.lit(PREFIXES)).cast("int"))


def _exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(os.path.join(path, "_SUCCESS"))
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def p5_found(spark, sf_dir):
    jobs = (("filter_output", "row_ordinal", "c1", "c3", None), ("report_analysis_text", "text_id", "c1", "pdf_url", "pdf_text"))
    with ThreadPoolExecutor(len(jobs)) as pool:  # two tables that do not wait for each other
        done = list(pool.map(lambda j: repeats(check_all(table(spark, sf_dir, j[0]), *j[1:])), jobs))
    a, b = (d.select(F.lit(j[0]).alias("tab"), "first_id", "dup_id") for j, d in zip(jobs, done))
    return a.unionByName(b)


def p5_last_batch(spark, sf_dir):
    """(text_id, first_id) of each row of the newest batch of report_analysis_text, checked against a store of all earlier ones.

    `first_id` is null where the row is accepted.
    """
    df, store = table(spark, sf_dir, "report_analysis_text"), place(spark, "p5-store")
    number = F.coalesce("batch_num", F.lit(-1))
    last = df.agg(F.max(number)).first()[0]
    columns = ("text_id", "c1", "pdf_url", "pdf_text")
    accept_batch(spark, df.filter(number < F.lit(last)), store, *columns, arrived=1)
    batch = df.filter(number == F.lit(last))
    found = accept_batch(spark, batch, store, *columns, arrived=2).withColumnRenamed("dup_id", "text_id")
    return batch.select("text_id").distinct().join(found, "text_id", "left")


def p5_coverage(spark, sf_dir):
    """Best coverage of each text of report_analysis_text by an earlier record of its kin, repeat or not."""
    _, met = check_all(table(spark, sf_dir, "report_analysis_text"), "text_id", "c1", "pdf_url", "pdf_text")
    best = F.max_by(F.struct("first_id", "address_cover", "text_cover", "repeats"), F.struct("text_cover", "address_cover", -F.col("first_id")))
    return met.groupBy("dup_id").agg(best.alias("b")).select("dup_id", "b.*")
