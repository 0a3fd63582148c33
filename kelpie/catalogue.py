"""Queries over the driver's tables and their SQL twins.

The change log of all of them is made of `events`: key = user_id as text, seq = event_id + 1, a tombstone for each
'error' event, value = props (empty in tombstones).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import scalars
from .operators import bloom, changelog, compaction, layout, reads
from .plans import manifest as plans
from .sources import formats
from .sources.files import Files, shared_folder
from .store import Store
from .streaming import ingest

#: Parameters of the queries.
READ_SEQ, RANGE = 5000, ("12", "5")
FLUSH_BYTES, SLICE_BYTES, BLOCK_BYTES, BASE_BYTES = 40960, 16384, 4096, 100_000


def log(spark: SparkSession, d: str) -> DataFrame:
    e = spark.read.parquet(f"{d}/events.parquet")
    dead = F.coalesce(F.col("event_type") == "error", F.lit(False))
    return e.select(
        F.col("user_id").cast("string").alias("key"), (F.col("event_id") + 1).alias("seq"), F.when(dead, 1).otherwise(0).cast("tinyint").alias("type"), F.when(dead, "").otherwise(F.coalesce("props", F.lit(""))).alias("value")
    )


LOG = """log as (select cast(user_id as varchar) as key, event_id + 1 as seq, case when event_type = 'error' then 1 else 0 end::tinyint as type,
  case when event_type = 'error' then '' else coalesce(props, '') end as value from events)"""
NEWEST = "newest as (select * from log qualify row_number() over (partition by key order by seq desc) = 1)"


def folds(name: str, source: str, order: str, size: str, threshold: int) -> str:
    """Recursive SQL for runs that close once their bytes exceed the threshold."""
    return f"""{name}_rows as (select *, row_number() over (order by {order}) as rn, {size} as b from {source}),
{name} as (select rn, b as acc, 0::bigint as run from {name}_rows where rn = 1 union all
  select r.rn, case when f.acc > {threshold} then r.b else f.acc + r.b end, f.run + case when f.acc > {threshold} then 1 else 0 end
  from {name} f join {name}_rows r on r.rn = f.rn + 1)"""


FLUSH = folds("flush", "log", "seq", "strlen(key) + strlen(value) + 9", FLUSH_BYTES)
PER_KEY = "per_key as (select key, sum(strlen(key) + strlen(value) + 21)::bigint as bytes from log group by key)"
SLICE = PER_KEY + ", " + folds("slice", "per_key", "key", "bytes", SLICE_BYTES)
FLUSHED = "flushed as (select r.key, r.seq, r.type, r.value, f.run from flush f join flush_rows r using (rn))"
SLICED = "sliced as (select l.key, l.seq, l.type, l.value, f.run from slice f join slice_rows r using (rn) join log l on l.key = r.key)"
META = "select run as number, count(*)::bigint as records, sum(strlen(key) + strlen(value) + 21)::bigint as size, min(key) as min_key, max(key) as max_key, min(seq) as min_seq, max(seq) as max_seq"
ALL_META = f"with recursive {LOG}, {FLUSH}, {FLUSHED}, {SLICE}, {SLICED}, zero as ({META} from flushed group by run), one as ({META} from sliced group by run)"

QUERIES: dict = {}
ORACLES: dict = {}


def query(name: str, oracle: str | None = None):
    def register(f):
        QUERIES[name] = f
        if oracle:
            ORACLES[name] = oracle
        return f

    return register


# ---- reads


@query("latest_visible", f"with {LOG}, {NEWEST} select key, seq, value from newest where type = 0")
def latest_visible(spark, d):
    return reads.latest(log(spark, d)).select("key", "seq", "value")


@query("scan_range", f"with {LOG}, {NEWEST} select key, seq, value from newest where type = 0 and key >= '{RANGE[0]}' and key < '{RANGE[1]}'")
def scan_range(spark, d):
    return reads.scan(log(spark, d), *RANGE).select("key", "seq", "value")


@query("scan_snapshot", f"with {LOG} select key, seq, value from (select * from log where seq <= {READ_SEQ} and key >= '{RANGE[0]}' and key < '{RANGE[1]}' qualify row_number() over (partition by key order by seq desc) = 1) where type = 0")
def scan_snapshot(spark, d):
    return reads.scan(log(spark, d), *RANGE, READ_SEQ).select("key", "seq", "value")


@query("latest_at", f"with {LOG} select key, seq, value from (select * from log where seq <= {READ_SEQ} qualify row_number() over (partition by key order by seq desc) = 1) where type = 0")
def latest_at(spark, d):
    return reads.latest(log(spark, d), READ_SEQ).select("key", "seq", "value")


@query("point_get", f"with {LOG} select key, seq, value from (select * from log where key = '7' order by seq desc limit 1) where type = 0")
def point_get(spark, d):
    return reads.get(log(spark, d), "7").select("key", "seq", "value")


@query("multi_get", f"with {LOG}, {NEWEST} select p.key, case when n.type is null then 'ABSENT' when n.type = 1 then 'TOMBSTONE' else 'VALUE' end as state, n.seq, case when n.type = 0 then n.value end as value from (select cast(c_custkey as varchar) as key from customer) p left join newest n using (key)")
def multi_get(spark, d):
    probes = spark.read.parquet(f"{d}/customer.parquet").select(F.col("c_custkey").cast("string").alias("key"))
    return reads.multi_get(log(spark, d), probes).select("key", "state", "seq", "value")


@query("as_of_get", f"with {LOG}, p as (select o_orderkey as probe, cast(o_custkey as varchar) as key, o_orderkey as read_seq from orders), h as (select p.probe, p.key, l.seq, l.type, l.value from p asof left join log l on p.key = l.key and p.read_seq >= l.seq) select probe, key, case when type is null then 'ABSENT' when type = 1 then 'TOMBSTONE' else 'VALUE' end as state, case when type = 0 then seq end as seq, case when type = 0 then value end as value from h")
def as_of_get(spark, d):
    probes = spark.read.parquet(f"{d}/orders.parquet").select(F.col("o_orderkey").alias("probe"), F.col("o_custkey").cast("string").alias("key"), F.col("o_orderkey").alias("read_seq"))
    return reads.as_of(log(spark, d), probes, "probe")


@query("version_history", f"with {LOG} select key, seq, type, value, row_number() over (partition by key order by seq desc)::bigint as version, lag(seq) over (partition by key order by seq desc) as replaced_at from log")
def version_history(spark, d):
    return reads.history(log(spark, d))


@query("tombstones", f"with {LOG}, {NEWEST} select key, seq from newest where type = 1")
def tombstones(spark, d):
    return reads.tombstones(log(spark, d)).select("key", "seq")


@query("merge_all", f"with {LOG} select * from log")
def merge_all(spark, d):
    whole = log(spark, d)
    return reads.merge([whole.where(F.pmod(F.xxhash64("key", "seq"), F.lit(3)) == i) for i in range(3)])


# ---- writes


@query("batch_seq", "select cast(user_id as varchar) as key, 1000 + row_number() over (order by event_id) as seq, case when event_type = 'error' then 1 else 0 end::tinyint as type, case when event_type = 'error' then '' else coalesce(props, '') end as value from events")
def batch_seq(spark, d):
    e = spark.read.parquet(f"{d}/events.parquet")
    ops = e.select(F.col("event_id").alias("op_idx"), F.when(F.col("event_type") == "error", "remove").otherwise("put").alias("op"), F.col("user_id").cast("string").alias("key"), F.coalesce("props", F.lit("")).alias("value"))
    return changelog.assign_sequence(ops, 1000, block=1000)


@query("last_write_wins", "select cast(user_id as varchar) as key, (event_id // 100)::bigint as seq, coalesce(props, '') as value from events qualify row_number() over (partition by user_id, event_id // 100 order by event_id desc) = 1")
def last_write_wins(spark, d):
    e = spark.read.parquet(f"{d}/events.parquet")
    rows = e.select(F.col("user_id").cast("string").alias("key"), F.floor(F.col("event_id") / 100).alias("seq"), F.coalesce("props", F.lit("")).alias("value"), "event_id")
    return changelog.last_write_wins(rows, "event_id")


@query("tail_statistics", f"with {LOG} select count(*)::bigint as entries, sum(strlen(key) + strlen(value) + 9)::bigint as bytes, max(seq) as max_seq from log")
def tail_statistics(spark, d):
    return changelog.tail_statistics(log(spark, d))


@query("log_payload", f"with {LOG} select seq, (case when type = 0 then 'P,' else 'D,' end) || seq || ',' || strlen(key) || ',' || key || '=' || strlen(value) || ',' || value || chr(10) as payload from log")
def log_payload(spark, d):
    return log(spark, d).select("seq", scalars.log_record(F.col("key"), F.col("seq"), F.col("type"), F.col("value")).alias("payload"))


@query("replace_tables", f"{ALL_META} select number, size, min_key, max_key from zero where number not in (0, 2) union all select number + 1000, size, min_key, max_key from one")
def replace_tables(spark, d):
    meta = lambda df: df.select("number", "size", "min_key", "max_key")
    removed = spark.createDataFrame([(0,), (2,)], "number long")
    return plans.replace_tables(meta(zero_meta(spark, d)), removed, meta(one_meta(spark, d)).withColumn("number", F.col("number") + 1000))


# ---- layout


def flushed(spark, d):
    return layout.flush_runs(log(spark, d), FLUSH_BYTES)


def sliced(spark, d):
    return layout.slices(log(spark, d), SLICE_BYTES)


def zero_meta(spark, d):
    return plans.table_meta(flushed(spark, d), "run", scalars.encoded_size())


def one_meta(spark, d):
    return plans.table_meta(sliced(spark, d), "run", scalars.encoded_size())


@query("flush_assignment", f"with recursive {LOG}, {FLUSH}, {FLUSHED} select seq, run from flushed")
def flush_assignment(spark, d):
    return flushed(spark, d).select("seq", "run")


@query("table_meta", f"{ALL_META} select * from zero")
def table_meta(spark, d):
    return zero_meta(spark, d)


@query("slice_output", f"with recursive {LOG}, {SLICE}, {SLICED} select key, seq, run from sliced")
def slice_output(spark, d):
    return sliced(spark, d).select("key", "seq", "run")


@query("block_index", f"with recursive {LOG}, {folds('block', 'log', 'key, seq desc', 'strlen(key) + strlen(value) + 21', BLOCK_BYTES)}, g as (select f.run, arg_min(r.key, rn) as key, sum(r.b)::bigint as bytes from block f join block_rows r using (rn) group by f.run) select run, key, coalesce(sum(bytes) over (order by run rows between unbounded preceding and 1 preceding), 0)::bigint as \"offset\" from g")
def block_index(spark, d):
    return layout.index_blocks(log(spark, d), BLOCK_BYTES)


@query("entry_bytes", f"with {LOG} select key, sum(strlen(key) + strlen(value) + 21)::bigint as encoded_bytes, sum(strlen(key) + strlen(value) + 9)::bigint as entry_bytes from log group by key")
def entry_bytes(spark, d):
    return log(spark, d).groupBy("key").agg(F.sum(scalars.encoded_size()).alias("encoded_bytes"), F.sum(scalars.entry_size()).alias("entry_bytes"))


# ---- manifest and compaction


@query("l0_hull", f"{ALL_META} select min(min_key) as min_key, max(max_key) as max_key from zero")
def l0_hull(spark, d):
    return zero_meta(spark, d).agg(F.min("min_key").alias("min_key"), F.max("max_key").alias("max_key"))


@query("overlap_join", f"{ALL_META} select a.number as left_number, b.number as right_number from zero a join one b on a.min_key <= b.max_key and a.max_key >= b.min_key")
def overlap_join(spark, d):
    return plans.overlaps(zero_meta(spark, d), one_meta(spark, d))


@query("key_to_table", f"{ALL_META}, keys as (select cast(c_custkey as varchar) as key from customer) select keys.key, one.number from keys left join one on keys.key between one.min_key and one.max_key")
def key_to_table(spark, d):
    keys = spark.read.parquet(f"{d}/customer.parquet").select(F.col("c_custkey").cast("string").alias("key"))
    return plans.key_to_table(keys, one_meta(spark, d))


def levels(spark, d):
    zero = zero_meta(spark, d).select("number", F.lit(0).alias("level"), "size", "min_key", "max_key")
    return zero.unionByName(one_meta(spark, d).select(F.col("number") + 1000, F.lit(1), "size", "min_key", "max_key").toDF(*zero.columns))


LEVELS = f"{ALL_META}, levels as (select number, 0 as level, size, min_key, max_key from zero union all select number + 1000, 1, size, min_key, max_key from one)"


@query("level_sizes_budget", f"{LEVELS} select level, count(*)::bigint as tables, sum(size)::bigint as size, case when level >= 1 then {BASE_BYTES} * 10 ** (level - 1) end::bigint as budget, coalesce(level >= 1 and sum(size) > {BASE_BYTES} * 10 ** (level - 1), false) as over from levels group by level")
def level_sizes_budget(spark, d):
    return compaction.level_sizes(levels(spark, d), BASE_BYTES)


@query("scan_pruning", f"{LEVELS} select number, level from levels where max_key >= '{RANGE[0]}' and min_key < '{RANGE[1]}'")
def scan_pruning(spark, d):
    return levels(spark, d).where((F.col("max_key") >= RANGE[0]) & (F.col("min_key") < RANGE[1])).select("number", "level")


@query("compaction_inputs", f"{LEVELS}, hull as (select min(min_key) as lo, max(max_key) as hi from levels where level = 0) select number, level from levels, hull where level = 0 or (level = 1 and min_key <= hi and max_key >= lo)")
def compaction_inputs(spark, d):
    return compaction.level_zero_inputs(levels(spark, d)).select("number", "level")


@query("next_compaction", f"{LEVELS} select number, min_key from levels where level = 1 order by case when min_key > '30' then 0 else 1 end, min_key limit 1")
def next_compaction(spark, d):
    return compaction.next_table(levels(spark, d), 1, "30").select("number", "min_key")


@query("next_level_overlap", f"{LEVELS} select o.number from levels o where o.level = 1 and exists (select 1 from levels z where z.level = 0 and z.number = 0 and o.min_key <= z.max_key and o.max_key >= z.min_key)")
def next_level_overlap(spark, d):
    tables = levels(spark, d)
    return compaction.overlapping(tables, tables.where("level = 0 and number = 0"), 1).select("number")


@query("retain_compaction", f"with {LOG} select key, seq, type, value from log l where seq > {READ_SEQ} or seq = (select max(seq) from log m where m.key = l.key and m.seq <= {READ_SEQ})")
def retain_compaction(spark, d):
    return compaction.retain(log(spark, d), READ_SEQ)


@query("untracked_files", "select 'sst_' || p_partkey || '.sst' as name, p_partkey::bigint as number from part where p_partkey not in (select l_partkey from lineitem where l_quantity > 45)")
def untracked_files(spark, d):
    files = spark.read.parquet(f"{d}/part.parquet").select(F.concat(F.lit("sst_"), F.col("p_partkey").cast("string"), F.lit(".sst")).alias("name"))
    active = spark.read.parquet(f"{d}/lineitem.parquet").where("l_quantity > 45").select(F.col("l_partkey").alias("number"))
    return files.withColumn("number", scalars.file_number(F.col("name"), "sst_", ".sst")).join(active, "number", "left_anti").select("name", "number")


_NAMES = "select case p_size % 5 when 0 then 'sst_' || p_partkey || '.sst' when 1 then 'sst_00' || p_partkey || '.sst' when 2 then 'sst_' || p_partkey || 'x.sst' when 3 then 'tmp_sst_' || p_partkey || '.sst' else 'sst_' || p_partkey || '.sst.tmp' end as name from part"


@query("file_number_parse", f"select name, try_cast(nullif(regexp_extract(name, '^sst_([0-9]+)[.]sst$', 1), '') as bigint) as number from ({_NAMES})")
def file_number_parse(spark, d):
    p = spark.read.parquet(f"{d}/part.parquet")
    k, kind = F.col("p_partkey").cast("string"), F.col("p_size") % 5
    name = F.when(kind == 0, F.concat(F.lit("sst_"), k, F.lit(".sst"))).when(kind == 1, F.concat(F.lit("sst_00"), k, F.lit(".sst"))).when(kind == 2, F.concat(F.lit("sst_"), k, F.lit("x.sst")))
    name = name.when(kind == 3, F.concat(F.lit("tmp_sst_"), k, F.lit(".sst"))).otherwise(F.concat(F.lit("sst_"), k, F.lit(".sst.tmp")))
    return p.select(name.alias("name")).withColumn("number", scalars.file_number(F.col("name"), "sst_", ".sst"))


@query("file_paths", "select p_partkey::bigint as number, 'data/wal/wal_' || p_partkey || '.wal' as log_path, 'data/sstable/sst_' || p_partkey || '.sst' as table_path from part")
def file_paths(spark, d):
    number = F.col("p_partkey").cast("long")
    return spark.read.parquet(f"{d}/part.parquet").select(number.alias("number"), scalars.log_path(F.lit("data"), number).alias("log_path"), scalars.table_path(F.lit("data"), number).alias("table_path"))


# ---- encodings, hashes and filters

_LE = lambda x, n: " || ".join(f"printf('%02X', ({x} >> {8 * i}) & 255)" for i in range(n))
_FNV = """list_reduce(list_prepend(14695981039346656037::hugeint, list_transform(range(1, strlen(key) + 1), lambda i: ('0x' || hex(encode(key))[2 * i - 1 : 2 * i])::hugeint)),
  lambda h, b: (xor(h, b) * 1099511628211) % 18446744073709551616)"""

_CRC = """list_reduce(list_prepend(4294967295::bigint, list_transform(range(1, strlen(image) // 2 + 1), lambda i: ('0x' || image[2 * i - 1 : 2 * i])::bigint)),
  lambda c, b: list_reduce(list_prepend(xor(c, b), [0::bigint, 0, 0, 0, 0, 0, 0, 0]), lambda x, z: xor(x >> 1, (x & 1) * 3988292384)))"""


@query("encode_record", f"with {LOG} select seq, printf('%02X', type) || {_LE('seq', 8)} || {_LE('strlen(key)', 4)} || {_LE('strlen(value)', 4)} || hex(encode(key)) || hex(encode(value)) as image from log")
def encode_record(spark, d):
    return log(spark, d).select("seq", F.hex(scalars.encode_record(F.col("key"), F.col("seq"), F.col("type"), F.col("value"))).alias("image"))


@query("crc32_record", f"""with {LOG}, images as (select seq, printf('%02X', type) || {_LE('seq', 8)} || {_LE('strlen(key)', 4)} || {_LE('strlen(value)', 4)} || hex(encode(key)) || hex(encode(value)) as image from log)
  select seq, xor({_CRC}, 4294967295)::bigint as checksum from images""")
def crc32_record(spark, d):
    return log(spark, d).select("seq", scalars.record_checksum(F.col("key"), F.col("seq"), F.col("type"), F.col("value")).alias("checksum"))


def customer_keys(spark, d):
    return spark.read.parquet(f"{d}/customer.parquet").select(F.col("c_name").alias("key"))


_KEYS = "keys as (select c_name as key from customer), n as (select count(*) as n from keys), par as (select ceil(-n * ln(0.01) / (ln(2) * ln(2)))::bigint as bits, round(-ln(0.01) / ln(2))::bigint as hashes from n)"
_POSITIONS = f"fnv as (select key, {_FNV} as h from keys), half as (select key, (h // 4294967296)::bigint as hi, case when h % 4294967296 = 0 then 1 else (h % 4294967296)::bigint end as lo from fnv)"


@query("fnv1a", f"with {_KEYS}, fnv as (select key, {_FNV} as h from keys) select key, lower(printf('%08X', (h // 4294967296)::bigint) || printf('%08X', (h % 4294967296)::bigint)) as hash from fnv")
def fnv1a(spark, d):
    return customer_keys(spark, d).select("key", scalars.fnv1a_hex(F.col("key")).alias("hash"))


@query("bloom_parameters", f"with {_KEYS} select bits, hashes from par")
def bloom_parameters(spark, d):
    bits, hashes = scalars.bloom_parameters(customer_keys(spark, d).count())
    return spark.range(1).select(F.lit(bits).cast("long").alias("bits"), F.lit(hashes).cast("long").alias("hashes"))


@query("bloom_bits", f"with {_KEYS}, {_POSITIONS} select distinct ((hi + i * lo) % bits)::bigint as position from half, par, range(hashes) t(i)")
def bloom_bits(spark, d):
    keys = customer_keys(spark, d)
    return bloom.build(keys, *scalars.bloom_parameters(keys.count()))


@query("bloom_words", f"with {_KEYS}, {_POSITIONS}, b as (select distinct ((hi + i * lo) % bits)::bigint as position from half, par, range(hashes) t(i)), w as (select position // 64 as word, sum(1::hugeint << (position % 64)::int) as u from b group by 1) select word::bigint as word, (case when u >= 9223372036854775808 then u - 18446744073709551616 else u end)::bigint as bits from w")
def bloom_words(spark, d):
    return bloom.words(bloom_bits(spark, d))


@query("bloom_probe", f"with {_KEYS}, {_POSITIONS}, b as (select distinct ((hi + i * lo) % bits)::bigint as position from half, par, range(hashes) t(i)), p as (select distinct p_name as key from part union select key from keys), pf as (select key, {_FNV} as h from p), ph as (select key, (h // 4294967296)::bigint as hi, case when h % 4294967296 = 0 then 1 else (h % 4294967296)::bigint end as lo from pf), q as (select distinct key, ((hi + i * lo) % bits)::bigint as position from ph, par, range(hashes) t(i)) select key, count(*) = count(b.position) as maybe from q left join b using (position) group by key")
def bloom_probe(spark, d):
    keys = customer_keys(spark, d)
    bits, hashes = scalars.bloom_parameters(keys.count())
    probes = spark.read.parquet(f"{d}/part.parquet").select(F.col("p_name").alias("key")).union(keys).distinct()
    return bloom.probe(probes, bloom.build(keys, bits, hashes), bits, hashes)


@query("table_images", f"with recursive {LOG}, {FLUSH}, {FLUSHED} select key, seq, type, value from flushed")
def table_images(spark, d):
    """Every flush as a table-file image, parsed back."""
    images = formats.table_images(flushed(spark, d).select(F.col("key").cast("binary").alias("key"), "seq", "type", F.col("value").cast("binary").alias("value"), "run"), "run")

    def parse(batches):
        import pyarrow as pa

        for b in batches:
            for content in b.column("content").to_pylist():
                rows = list(formats.parse_records(formats.table_parts(content)[0]))
                yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.binary(), pa.int64(), pa.int8(), pa.binary()), strict=True)], ["key", "seq", "type", "value"])

    out = images.select("content").mapInArrow(parse, "key binary, seq long, type byte, value binary")
    return out.select(F.col("key").cast("string").alias("key"), "seq", "type", F.col("value").cast("string").alias("value"))


def _binary(df):
    return df.withColumns({"key": F.col("key").cast("binary"), "value": F.col("value").cast("binary")})


@query("wal_replay", f"with {LOG} select key, seq, type, value from log")
def wal_replay(spark, d):
    """The log as write-ahead logs of committed batches, read back."""
    images = formats.log_images(_binary(log(spark, d)).withColumn("run", F.expr("seq div 2500")), "run", 100)

    def parse(batches):
        import pyarrow as pa

        for b in batches:
            for content in b.column("content").to_pylist():
                rows = formats.parse_log(content)[0]
                yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.binary(), pa.int64(), pa.int8(), pa.binary()), strict=True)], ["key", "seq", "type", "value"])

    out = images.select("content").mapInArrow(parse, "key binary, seq long, type byte, value binary")
    return out.withColumns({"key": F.col("key").cast("string"), "value": F.col("value").cast("string")})


@query("table_lookup", f"with recursive {LOG}, {FLUSH}, {FLUSHED} select run, key, seq, type from flushed qualify row_number() over (partition by run, key order by seq desc) = 1")
def table_lookup(spark, d):
    """Every key of every flush, and one that is in none, looked up in the flush's table image."""
    rows = _binary(flushed(spark, d))
    probes = rows.select("run", "key").distinct()
    absent = rows.select("run", F.lit("none").cast("binary").alias("key")).distinct()
    found = formats.find_in_tables(formats.table_images(rows, "run"), probes.union(absent))
    return found.withColumn("key", F.col("key").cast("string"))


INDEX = f"with recursive {LOG}, {folds('block', 'log', 'key, seq desc', 'strlen(key) + strlen(value) + 21', BLOCK_BYTES)}, g as (select f.run, arg_min(r.key, rn) as key, sum(r.b)::bigint as bytes from block f join block_rows r using (rn) group by f.run), idx as (select run, key, coalesce(sum(bytes) over (order by run rows between unbounded preceding and 1 preceding), 0)::bigint as \"offset\" from g)"


@query("index_lookup", f"{INDEX}, p as (select distinct cast(c_custkey as varchar) as key from customer) select p.key, case when p.key >= (select min(key) from idx) then coalesce((select max(\"offset\") from idx where idx.key < p.key), 0) end as \"offset\" from p")
def index_lookup(spark, d):
    keys = spark.read.parquet(f"{d}/customer.parquet").select(F.col("c_custkey").cast("string").alias("key"))
    return layout.index_lookup(layout.index_blocks(log(spark, d), BLOCK_BYTES), keys)


@query("index_faults", f"{INDEX}, broken as (select case when run % 5 = 2 then '~' else key end as key, \"offset\" from idx) select key, \"offset\" from broken qualify lag(key) over (order by \"offset\") > key")
def index_faults(spark, d):
    """The index with every fifth key replaced by a great one."""
    rows = log(spark, d)
    index = layout.index_blocks(rows, BLOCK_BYTES).select(F.when(F.col("run") % 5 == 2, "~").otherwise(F.col("key")).alias("key"), "offset")
    return layout.index_faults(index, rows.agg(F.sum(scalars.encoded_size())).first()[0] or 0)


@query("first_over_budget", f"{LEVELS} select level, sum(size)::bigint as size, ({BASE_BYTES} * 10 ** (level - 1))::bigint as budget from levels where level >= 1 group by level having sum(size) > {BASE_BYTES} * 10 ** (level - 1) order by level limit 1")
def first_over_budget(spark, d):
    return compaction.first_over_budget(levels(spark, d), BASE_BYTES)


@query("level_faults", f"{LEVELS}, one_level as (select number, 1 as level, min_key, max_key from levels) select number, level from one_level qualify min_key <= max(max_key) over (order by min_key, number rows between unbounded preceding and 1 preceding)")
def level_faults(spark, d):
    """Tables of both levels, put into one that has to be disjoint."""
    return plans.level_faults(levels(spark, d).withColumn("level", F.lit(1)))


@query("bloom_image", f"with {_KEYS}, {_POSITIONS}, b as (select distinct ((hi + i * lo) % bits)::bigint as position from half, par, range(hashes) t(i)), bytes as (select t.byte, coalesce(sum(1 << (position % 8)::int) filter (position is not null), 0)::bigint as v from par, range((bits + 63) // 64 * 8) t(byte) left join b on position // 8 = t.byte group by t.byte) select {_LE('bits', 8)} || {_LE('hashes', 8)} || (select string_agg(printf('%02X', v), '' order by byte) from bytes) as image from par")
def bloom_image(spark, d):
    keys = customer_keys(spark, d)
    bits, hashes = scalars.bloom_parameters(keys.count())
    return bloom.image(bloom.build(keys, bits, hashes), bits, hashes).select(F.hex("image").alias("image"))


# ---- the store and streams


def operations(spark, d):
    e = spark.read.parquet(f"{d}/events.parquet")
    return e.select(F.col("event_id").alias("op_idx"), F.when(F.col("event_type") == "error", "remove").otherwise("put").alias("op"), F.col("user_id").cast("string").cast("binary").alias("key"), F.coalesce("props", F.lit("")).cast("binary").alias("value"))


@query("store_scan", f"with {LOG}, {NEWEST} select key, n.seq, value from (select key, value, type, (select count(*) from log l where l.seq <= newest.seq) as seq from newest) n where type = 0")
def store_scan(spark, d):
    """Three batches through log, flush, compaction and scan."""
    store = Store(spark, shared_folder(spark), flush_bytes=1 << 40, slice_bytes=1 << 20)
    ops = operations(spark, d)
    n = ops.agg(F.max("op_idx")).first()[0] or 0
    for i in range(3):
        store.write_frame(ops.where((F.col("op_idx") >= i * (n // 3)) & ((F.col("op_idx") < (i + 1) * (n // 3)) if i < 2 else F.lit(True))))
        store.flush()
    store.compact()
    found = store.scan(b"", b"~")
    return found.select(F.col("key").cast("string").alias("key"), "seq", F.col("value").cast("string").alias("value"))


def written(spark, d, flushed: bool) -> tuple[Store, list]:
    """A store of three batches of the operations and a snapshot after each."""
    store = Store(spark, shared_folder(spark), flush_bytes=1 << 40, slice_bytes=1 << 20)
    ops = operations(spark, d)
    n, snaps = ops.agg(F.max("op_idx")).first()[0] or 0, []
    for i in range(3):
        store.write_frame(ops.where((F.col("op_idx") >= i * (n // 3)) & ((F.col("op_idx") < (i + 1) * (n // 3)) if i < 2 else F.lit(True))))
        snaps.append(store.snapshot())
        if flushed or i < 2:
            store.flush()
    return store, snaps


RANKED = "ranked as (select key, row_number() over (order by seq) as seq, type, value from log)"
CUTS = "cuts as (select 0 as snap, (select count(*) from events where event_id < (select max(event_id) // 3 from events)) as cut union all select 1, (select count(*) from events where event_id < (select max(event_id) // 3 * 2 from events)) union all select 2, (select count(*) from events))"


@query("store_snapshots", f"with {LOG}, {RANKED}, {CUTS} select snap, key, seq, value from (select * from ranked join cuts on seq <= cut qualify row_number() over (partition by snap, key order by seq desc) = 1) where type = 0")
def store_snapshots(spark, d):
    """What each open snapshot sees after flushes and a compaction."""
    store, snaps = written(spark, d, True)
    store.compact()
    found = [store.scan(b"", b"~", s.seq).select(F.lit(i).alias("snap"), F.col("key").cast("string").alias("key"), "seq", F.col("value").cast("string").alias("value")) for i, s in enumerate(snaps)]
    return found[0].union(found[1]).union(found[2])


@query("store_readers", f"with {CUTS} select snap, (3 - snap)::int as active, cut::bigint as oldest from cuts")
def store_readers(spark, d):
    """Open snapshots and the oldest sequence that is read, while they are closed one by one."""
    store, snaps = written(spark, d, True)
    rows = []
    for i, s in enumerate(snaps):
        rows.append((i, store.active_snapshots, store.oldest_reader()))
        s.close()
    return spark.createDataFrame(rows, "snap int, active int, oldest long")


@query("store_recovery", f"with {LOG}, {RANKED} select key, seq, value from (select * from ranked qualify row_number() over (partition by key order by seq desc) = 1) where type = 0")
def store_recovery(spark, d):
    """A store that is opened again with an unflushed tail and the leftovers of a failed writer."""
    store, _ = written(spark, d, False)
    files = Files(spark)
    for left in ("tables/.new_77", "tables/table_77", "log/log_0/.new_5"):
        files.make_folder(f"{store.folder}/{left}")
    again = Store(spark, store.folder)
    assert not any(files.exists(f"{store.folder}/{x}") for x in ("tables/.new_77", "tables/table_77", "log/log_0"))
    return again.scan(b"", b"~").select(F.col("key").cast("string").alias("key"), "seq", F.col("value").cast("string").alias("value"))


@query("store_multi_get", f"with {LOG}, {RANKED}, n as (select * from ranked qualify row_number() over (partition by key order by seq desc) = 1) select p.key, case when n.type is null then 'ABSENT' when n.type = 1 then 'TOMBSTONE' else 'VALUE' end as state, n.seq from (select cast(c_custkey as varchar) as key from customer) p left join n using (key)")
def store_multi_get(spark, d):
    store, _ = written(spark, d, False)
    probes = spark.read.parquet(f"{d}/customer.parquet").select(F.col("c_custkey").cast("string").cast("binary").alias("key"))
    return store.multi_get(probes).select(F.col("key").cast("string").alias("key"), "state", "seq")


@query("stream_latest", f"with {LOG}, {NEWEST} select key, seq, value from newest where type = 0")
def stream_latest(spark, d):
    """The log as a stream of files, kept as the newest version of each key."""
    place = shared_folder(spark)
    log(spark, d).repartition(3).write.parquet(f"{place}/in")
    schema = spark.read.parquet(f"{place}/in").schema
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{place}/in")
    q = ingest.latest_view(source, f"{place}/view", f"{place}/checkpoint")
    q.awaitTermination()
    batches = q.lastProgress["batchId"] + 1 if q.lastProgress else 0
    return ingest.read_view(spark, f"{place}/view", batches).select("key", "seq", "value")
