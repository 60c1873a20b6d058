"""More queries: strips, files, artifacts, reports, generated inputs, wide integers, jobs; with the same in SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridloom.catalogue import DAY, NOW, query
from gridloom.functions import series, wide
from gridloom.operators import assembly, control, linalg, maps, quorum, sorting, telemetry
from gridloom.plans.engine import Engine
from gridloom.plans.registry import built_in
from gridloom.sources import artifacts, dense, records
from gridloom.storage import shared_folder, stored
from gridloom.tables import CELLS_SQL, CHUNKS_SQL, SAMPLES_SQL, SUBMISSIONS_SQL, cells, chunks, load, micros, samples, submissions, whole_rows

# strips and products


@query("SELECT range AS strip, range * 96 AS first, least(96, 1000 - range * 96) AS height, range * 96 * 64 * 4 AS byte_offset, least(96, 1000 - range * 96) * 64 * 4 AS bytes FROM range(11)")
def row_strip_plan(spark, sf_dir):
    return linalg.row_strips(1000, 64, 96, spark)


@query(f"SELECT i, k, v FROM {CELLS_SQL}")
def row_strip_scatter(spark, sf_dir):
    strips = linalg.gather_strips(whole_rows(spark, sf_dir), 96)
    return linalg.scatter_strips(strips, 96).select("i", F.posexplode("row").alias("k", "v"))


@query(f"SELECT a.i, b.i AS j, CAST(sum(floor(a.v / 8) * floor(b.v / 8)) AS FLOAT) AS v FROM {CELLS_SQL} a JOIN {CELLS_SQL} b ON a.k = b.k WHERE a.i < 200 AND b.i < 150 GROUP BY ALL")
def matmul_half(spark, sf_dir):
    """16-bit inputs, 32-bit sums; the inputs are whole numbers that both hold exactly."""
    rows = whole_rows(spark, sf_dir).select("i", F.transform("row", lambda v: F.floor(v / 8)).alias("row"))
    a, b = (linalg.to_blocks(rows.where(F.col("i") < n), height=50, width=24) for n in (200, 150))
    return linalg.matmul_blocked(a, b, linalg.half_product, "float")


# plans and parameters


@query("SELECT range % 64 AS x, range // 64 AS y, CAST(0.25 AS DOUBLE) AS r, CAST(0.5 AS DOUBLE) AS g, CAST(0.75 AS DOUBLE) AS b, CAST(1 AS DOUBLE) AS a FROM range(64 * 48)")
def constant_colour(spark, sf_dir):
    return maps.constant_colour(spark, 64, 48, (0.25, 0.5, 0.75, 1.0))


@query("SELECT o_custkey AS job, count(*) * 3700 AS elements, CAST(1024 AS BIGINT) AS per_chunk, CAST(ceil(count(*) * 3700 / 1024) AS BIGINT) AS chunks FROM orders GROUP BY o_custkey")
def sort_chunk_plan(spark, sf_dir):
    jobs = load(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("job")).agg((F.count("*") * 3700).alias("elements"))
    return maps.chunk_plan(jobs, 4097)


@query("""SELECT p_partkey AS job, CASE WHEN p_size % 4 = 0 THEN [CAST(p_size AS BIGINT), 7] ELSE [CAST(ceil(p_size * 1000 / (p_partkey % 9 + 1)) AS BIGINT), CAST(ceil(p_partkey / (p_partkey % 9 + 1)) AS BIGINT)] END AS sizes FROM part""")
def output_sizes(spark, sf_dir):
    given = F.when(F.col("p_size") % 4 == 0, F.array(F.col("p_size").cast("long"), F.lit(7).cast("long")))
    jobs = load(spark, sf_dir, "part").select(F.col("p_partkey").alias("job"), given.alias("given"), F.array(F.col("p_size").cast("long") * 1000, "p_partkey").alias("total"), (F.col("p_partkey") % 9 + 1).alias("chunks"))
    return maps.output_sizes(jobs).select("job", "sizes")


@query("SELECT event_id, list_filter([event_id, user_id, CASE WHEN user_id % 2 = 0 THEN event_id % 7 END, CAST(json_extract_string(props, '$.k') AS BIGINT)], lambda v: v IS NOT NULL) AS picked FROM events")
def uniform_pick(spark, sf_dir):
    k = F.from_json("props", "k long")["k"]
    numbers = F.create_map(F.lit("zeta"), F.when(F.col("user_id") % 2 == 0, F.col("event_id") % 7), F.lit("tile_cols"), F.col("user_id"), F.lit("k"), k, F.lit("matrix_n"), F.col("event_id"))
    return load(spark, sf_dir, "events").select("event_id", maps.uniforms(numbers).alias("picked"))


# generated inputs


_UNIFORM = "CAST(('0x' || substring(sha256('{seed}/' || CAST(range AS VARCHAR)), 1, 13)) AS BIGINT) / CAST(4503599627370496 AS DOUBLE)"


@query(f"SELECT range AS idx, {_UNIFORM.format(seed='sort')} * 1000 AS v FROM range(5000)")
def sort_data(spark, sf_dir):
    return series.sort_data(spark, 5000, "sort")


@query(f"SELECT range AS idx, round(sin(range * 0.01), 9) AS wave, round(sqrt(-2 * ln(1 - {_UNIFORM.format(seed='n/u')})) * cos(2 * pi() * {_UNIFORM.format(seed='n/v')}) * 0.02, 9) AS weight FROM range(5000)")
def series_sine_normal(spark, sf_dir):
    i = F.col("id")
    return spark.range(5000).select(i.alias("idx"), F.round(series.sine(i), 9).alias("wave"), F.round(series.normal(i, "n", 0.02), 9).alias("weight"))


def _lcg_sql(seed: int) -> str:
    return f"(WITH RECURSIVE g AS (SELECT 0 AS n, CAST((9301 * {seed} + 49297) % 233280 AS BIGINT) AS s UNION ALL SELECT n + 1, (9301 * s + 49297) % 233280 FROM g WHERE n < 32 * 32 - 1) SELECT * FROM g)"


@query(f"""SELECT 'A' AS mat, CAST(n // 32 AS BIGINT) AS i, CAST(n % 32 AS BIGINT) AS k, CAST(floor(s / CAST(233280 AS DOUBLE) * 201) - 100 AS INTEGER) AS v FROM {_lcg_sql(42)}
UNION ALL SELECT 'B', CAST(n // 32 AS BIGINT), CAST(n % 32 AS BIGINT), CAST(floor(s / CAST(233280 AS DOUBLE) * 201) - 100 AS INTEGER) FROM {_lcg_sql(43)}""")
def random_matrix_pair(spark, sf_dir):
    a, b = (series.random_matrix(spark, 32, seed, "int", -100, 100) for seed in (42, 43))
    return a.select(F.lit("A").alias("mat"), "i", "k", "v").union(b.select(F.lit("B"), "i", "k", "v"))


@query("SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS at, epoch_us(ts) // 1000 AS ms FROM events")
def iso_times(spark, sf_dir):
    return load(spark, sf_dir, "events").select("event_id", series.iso(F.col("ts")).alias("at"), F.floor(F.expr(micros("ts")) / 1000).alias("ms"))


# wide integers

_BIG = "(o_orderkey * 1000003 + o_custkey)"
_EVEN = "CASE WHEN length(printf('%x', {0})) % 2 = 0 THEN printf('%x', {0}) ELSE '0' || printf('%x', {0}) END"


@query(f"""SELECT o_orderkey AS id, {_EVEN.format(_BIG)} AS hex, CAST({_BIG} AS VARCHAR) AS decimal, {_EVEN.format(f'gcd({_BIG}, CAST(720720 AS BIGINT))')} AS common,
    {_EVEN.format(f'CAST((CAST({_BIG} AS HUGEINT) * {_BIG}) % 1000003 AS BIGINT)')} AS square, {_EVEN.format(f'({_BIG} + {_BIG}) % 1000003')} AS double,
    upper(array_to_string(list_reverse(list_transform(range(32), lambda i: lpad(printf('%x', {_BIG}), 64, '0')[2 * i + 1:2 * i + 2])), '')) AS packed FROM orders""")
def wide_integers(spark, sf_dir):
    n = F.lit(wide.hex_text(1_000_003))
    ids = load(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), wide.decimal_to_hex((F.col("o_orderkey") * 1_000_003 + F.col("o_custkey")).cast("string")).alias("hex"))
    return ids.select("id", "hex", wide.hex_to_decimal("hex").alias("decimal"), wide.hex_gcd("hex", F.lit(wide.hex_text(720_720))).alias("common"), wide.hex_multiply("hex", "hex", n).alias("square"), wide.hex_add("hex", "hex", n).alias("double"), F.hex(wide.hex_to_u256("hex")).alias("packed"))


@query("SELECT o_orderkey AS id, (2 * o_orderkey + 1) % 4294967296 AS odd, CAST(1 AS BIGINT) AS product FROM orders")
def modular_inverses(spark, sf_dir):
    """Inverses modulo 2**32, and what they give times their number."""
    odd = (2 * F.col("o_orderkey") + 1) % (1 << 32)
    n = F.lit(wide.hex_text(1 << 32))
    found = load(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), odd.alias("odd"), wide.decimal_to_hex(odd.cast("string")).alias("hex"))
    product = wide.hex_to_decimal(wide.hex_multiply("hex", wide.hex_inverse("hex", n), n)).cast("long")
    return found.select("id", "odd", product.alias("product"))


@query(f"SELECT * FROM (VALUES {', '.join(f'(CAST({i} AS BIGINT), {chr(39)}{wide.hex_text(x)}{chr(39)})' for i, x in enumerate(wide.draw('ecm:fixture', 3 * 5 * 7 * 11 * 13 * 17, 40)))}) v(place, x)")
def coprime_numbers(spark, sf_dir):
    return wide.coprime_numbers(spark, "ecm:fixture", 3 * 5 * 7 * 11 * 13 * 17, 40)


# files and artifacts


@query(f"SELECT 'A' AS mat, i, CAST(k AS BIGINT) AS k, CAST(v AS FLOAT) AS v FROM {CELLS_SQL} WHERE i < 64 UNION ALL SELECT 'B', i - 64, CAST(k AS BIGINT), CAST(v AS FLOAT) FROM {CELLS_SQL} WHERE i >= 64 AND i < 128")
def dense_file_roundtrip(spark, sf_dir):
    """Two matrices written as one file and read by ranges of rows."""
    rows = cells(spark, sf_dir).where(F.col("i") < 128).select(F.when(F.col("i") < 64, "A").otherwise("B").alias("mat"), (F.col("i") % 64).alias("i"), F.col("k").cast("long").alias("k"), F.col("v").cast("float").alias("v"))
    path = f"{shared_folder(spark, 'dense')}.bin"
    dense.write_pair(rows, path)
    return dense.read_pair(spark, path, 16)


@query("SELECT event_type AS output, CAST(sum(octet_length(encode(props))) AS BIGINT) AS bytes, sha256(string_agg(props, '' ORDER BY event_id)) AS sha256 FROM events GROUP BY event_type")
def output_artifacts(spark, sf_dir):
    pieces = load(spark, sf_dir, "events").select(F.col("event_type").alias("output"), F.col("event_id").alias("seq"), F.encode("props", "utf-8").alias("data"))
    return artifacts.write_artifacts(pieces, shared_folder(spark, "artifacts")).select("output", "bytes", "sha256")


@query("SELECT 'output' AS output, CAST(sum(octet_length(encode(props))) AS BIGINT) AS bytes, sha256(string_agg(props, '' ORDER BY CASE event_type WHEN 'view' THEN 1 ELSE 2 END, event_id)) AS sha256 FROM events WHERE event_type IN ('view', 'click')")
def combined_artifact(spark, sf_dir):
    pieces = load(spark, sf_dir, "events").select(F.col("event_type").alias("output"), F.col("event_id").alias("seq"), F.encode("props", "utf-8").alias("data"))
    return artifacts.write_artifacts(pieces, shared_folder(spark, "artifacts"), combined=["view", "click"]).select("output", "bytes", "sha256")


@query("""SELECT n_regionkey AS job, regexp_replace(n_name, '[^A-Za-z0-9._-]', '_', 'g') AS name, CAST(octet_length(encode(n_name || '!')) AS BIGINT) AS bytes, sha256(n_name || '!') AS sha256,
    row_number() OVER (PARTITION BY n_regionkey ORDER BY regexp_replace(n_name, '[^A-Za-z0-9._-]', '_', 'g')) <= 3 AND octet_length(encode(n_name || '!')) <= 9 AS accepted FROM nation""")
def upload_limits(spark, sf_dir):
    inputs = load(spark, sf_dir, "nation").select(F.col("n_regionkey").alias("job"), F.col("n_name").alias("name"), F.encode(F.concat("n_name", F.lit("!")), "utf-8").alias("data"))
    return artifacts.keep_inputs(inputs, shared_folder(spark, "inputs"), max_files=3, max_bytes=9).drop("path")


@query(f"SELECT i, k, v FROM {CELLS_SQL}")
def stage_resume(spark, sf_dir):
    """A stage saved with its parameters, and taken up again."""
    stages = artifacts.StageStore(spark)
    stages.save("cells", cells(spark, sf_dir), {"scale": 1000})
    return stages.resume("cells", {"scale": 1000}, lambda: spark.createDataFrame([], "i long, k int, v long"))


# reports

_ISO = "strftime({0}, '%Y-%m-%dT%H:%M:%SZ')"


@query(f"""SELECT l_orderkey AS task_id, l_linenumber AS chunk_id, printf('%.2f', l_quantity) AS chunking_time_ms, CASE WHEN l_returnflag = 'R' THEN '' ELSE printf('%.2f', l_extendedprice) END AS client_processing_time_ms,
    printf('%.2f', l_quantity * 2) AS round_trip_time_ms, {_ISO.format('l_shipdate')} AS start_timestamp, CASE WHEN l_linestatus = 'F' THEN {_ISO.format('l_shipdate')} ELSE '' END AS completed_timestamp FROM lineitem""")
def timing_chunk_report(spark, sf_dir):
    lines = load(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("task_id"), F.col("l_linenumber").alias("chunk_id"), F.col("l_quantity").alias("chunking"), F.when(F.col("l_returnflag") != "R", F.col("l_extendedprice")).alias("client"), (F.col("l_quantity") * 2).alias("round_trip"), F.col("l_shipdate").alias("started"), F.when(F.col("l_linestatus") == "F", F.col("l_shipdate")).alias("completed"))
    return records.chunk_times(lines)


@query(f"""SELECT o_orderkey AS task_id, CASE WHEN o_orderstatus = 'P' THEN 'Unknown' ELSE o_orderstatus END AS label, 'linear' AS strategy, o_orderpriority AS framework, '{{"size":' || o_custkey || ',"block":64}}' AS parameters,
    printf('%.2f', o_totalprice) AS total_time_ms, coalesce(n, 0) AS chunks_count, {_ISO.format('o_orderdate')} AS start_timestamp, '' AS completed_timestamp
FROM orders LEFT JOIN (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY l_orderkey) ON l_orderkey = o_orderkey""")
def timing_job_report(spark, sf_dir):
    sizes = load(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("task_id")).agg(F.count("*").alias("chunks"))
    jobs = load(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("task_id"), F.when(F.col("o_orderstatus") != "P", F.col("o_orderstatus")).alias("label"), F.lit("linear").alias("strategy"), F.col("o_orderpriority").alias("framework"), F.col("o_totalprice").alias("total"), F.col("o_orderdate").alias("started"), F.lit(None).cast("timestamp_ntz").alias("completed"), F.col("o_custkey").alias("size"), F.lit(64).alias("block"))
    jobs = jobs.join(sizes, "task_id", "left").withColumn("chunks", F.coalesce("chunks", F.lit(0).cast("long")))
    return records.job_times(jobs, ["size", "block"])


@query("""SELECT l_orderkey AS job, '{"chunks":' || count(*) || ',"quantity":' || CAST(sum(CAST(round(l_quantity * 100) AS BIGINT)) AS BIGINT) || '}' AS descriptor FROM lineitem GROUP BY l_orderkey""")
def timing_descriptor(spark, sf_dir):
    times = load(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("job")).agg(F.count("*").alias("chunks"), F.sum(F.round(F.col("l_quantity") * 100).cast("long")).alias("quantity"))
    return records.job_descriptor(times)


# telemetry

_STEPS_SQL = f"(SELECT *, coalesce((lag(power) OVER w + power) * (us - lag(us) OVER w), 0) AS area FROM {SAMPLES_SQL} WINDOW w AS (PARTITION BY session ORDER BY us, sample))"


@query(f"""WITH s AS (SELECT session, process, area, CAST(10 + sample % 50 AS BIGINT) AS percent FROM {_STEPS_SQL} UNION ALL SELECT session, 'idle', area, 5 FROM {_STEPS_SQL} WHERE sample % 3 = 0)
SELECT session, process, CAST(sum(area * percent) AS BIGINT) AS energy_200, count(*) AS samples, CAST(sum(percent) // count(*) AS BIGINT) AS mean_percent FROM s GROUP BY session, process""")
def energy_by_percent(spark, sf_dir):
    own = F.create_map("process", 10 + F.col("sample") % 50)
    idle = F.when(F.col("sample") % 3 == 0, F.create_map(F.lit("idle"), F.lit(5).cast("long"))).otherwise(F.expr("CAST(map() AS map<string,bigint>)"))
    return telemetry.energy_by_percent(samples(spark, sf_dir).withColumn("percents", F.map_concat(own, idle)))


_SPANS_SQL = f"(SELECT session, us // {DAY} AS chunk, min(us) AS first, min(us) + (max(us) - min(us)) // 2 AS last FROM {SAMPLES_SQL} GROUP BY session, us // {DAY})"


@query(f"SELECT s.session, c.chunk, s.sample, s.us, s.power FROM {SAMPLES_SQL} s JOIN {_SPANS_SQL} c ON s.session = c.session AND s.us BETWEEN c.first AND c.last")
def samples_by_chunk(spark, sf_dir):
    taken = samples(spark, sf_dir)
    span = F.max("us") - F.min("us")
    spans = taken.groupBy("session", F.floor(F.col("us") / DAY).alias("chunk")).agg(F.min("us").alias("first"), (F.min("us") + F.floor(span / 2)).alias("last"))
    return telemetry.by_chunk(taken, spans)


# votes, queues, chunks


@query(f"""SELECT s.chunk, s.client, s.seq, s.payload, s.server_hash, s.reported_hash FROM {SUBMISSIONS_SQL} s JOIN (SELECT chunk, first_seq FROM (SELECT *, row_number() OVER (PARTITION BY chunk ORDER BY votes DESC, first_seq) AS r FROM (
    SELECT chunk, server_hash, count(DISTINCT client) AS votes, min(seq) AS first_seq FROM {SUBMISSIONS_SQL} WHERE server_hash = reported_hash GROUP BY chunk, server_hash HAVING count(DISTINCT client) >= 2)) WHERE r = 1) w ON s.chunk = w.chunk AND s.seq = w.first_seq""")
def winning_submissions(spark, sf_dir):
    return quorum.winning_rows(submissions(spark, sf_dir), 2).select("chunk", "client", "seq", "payload", "server_hash", "reported_hash")


@query(f"""WITH f AS (SELECT chunk, server_hash, client, min(seq) AS seq FROM {SUBMISSIONS_SQL} WHERE server_hash = reported_hash GROUP BY ALL), n AS (SELECT *, row_number() OVER (PARTITION BY chunk, server_hash ORDER BY seq) AS n FROM f),
d AS (SELECT chunk, min(seq) AS decided_at FROM n WHERE n = 2 GROUP BY chunk)
SELECT s.chunk, s.client, s.seq FROM {SUBMISSIONS_SQL} s LEFT JOIN d USING (chunk) WHERE d.decided_at IS NULL OR s.seq <= d.decided_at""")
def submissions_in_time(spark, sf_dir):
    return quorum.in_time(submissions(spark, sf_dir), 2).select("chunk", "client", "seq")


@query(f"SELECT c.chunk, c.parent, s.client, s.seq FROM {SUBMISSIONS_SQL} s JOIN {CHUNKS_SQL} c ON s.chunk = c.chunk")
def result_descriptors(spark, sf_dir):
    return assembly.with_descriptors(submissions(spark, sf_dir).select("chunk", "client", "seq"), chunks(spark, sf_dir).select("chunk", "parent")).select("chunk", "parent", "client", "seq")


@query("SELECT c_custkey AS id, row_number() OVER (ORDER BY coalesce(TRY_CAST(nullif(regexp_extract(c_name, '([0-9]+)$', 1), '') AS BIGINT), 0), c_name) - 1 AS index FROM customer")
def chunk_order_index(spark, sf_dir):
    return assembly.order_index(load(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), "c_name"), "c_name").select("id", "index")


_PARTS = "(SELECT l_partkey % 20 AS bi, l_suppkey % 20 AS bj, l_linenumber - 1 AS bk FROM lineitem)"


@query(f"""WITH b AS (SELECT bi, bj, count(DISTINCT bk) AS have, min(bk) AS first, max(bk) AS last FROM {_PARTS} GROUP BY bi, bj)
SELECT count(*) AS blocks, CAST(sum(have) AS BIGINT) AS parts, CAST(count(*) FILTER (have = 7 AND first = 0 AND last = 6) AS BIGINT) AS complete, count(*) = 400 AND sum(have) = 2800 AND count(*) FILTER (have = 7 AND first = 0 AND last = 6) = 400 AS valid FROM b""")
def assembly_verdict(spark, sf_dir):
    parts = load(spark, sf_dir, "lineitem").select((F.col("l_partkey") % 20).alias("bi"), (F.col("l_suppkey") % 20).alias("bj"), (F.col("l_linenumber") - 1).alias("bk"))
    return assembly.verdict(parts, 400, 7)


@query("SELECT l_orderkey AS id, count(*) AS n, CAST(sum(CAST(round(l_extendedprice * 100) AS BIGINT)) AS DOUBLE) / count(*) AS mean, substring(sha256(string_agg(CAST(CAST(round(l_extendedprice * 100) AS BIGINT) AS VARCHAR), ',' ORDER BY l_linenumber, CAST(CAST(round(l_extendedprice * 100) AS BIGINT) AS VARCHAR))), 1, 16) AS hash FROM lineitem GROUP BY l_orderkey")
def output_digests(spark, sf_dir):
    values = load(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("id"), "l_linenumber", F.round(F.col("l_extendedprice") * 100).cast("long").alias("v"))
    return assembly.digests(values, "id", "l_linenumber", "v")


_QUEUES = f"(SELECT parent, count(*) AS size, CAST(floor(max({NOW} - created) / 1000000) AS BIGINT) AS oldest_age, CAST(floor(CAST(sum({NOW} - created) AS DOUBLE) / count(*) / 1000000) AS BIGINT) AS mean_age, CAST(sum(chunk % 5) * 100 // count(*) AS BIGINT) AS mean_attempts FROM {CHUNKS_SQL} WHERE status = 'O' GROUP BY parent)"


@query(f"SELECT * FROM {_QUEUES}")
def queue_attempts(spark, sf_dir):
    open_ = chunks(spark, sf_dir).where("status = 'O'").withColumn("attempts", F.col("chunk") % 5)
    return control.queue_statistics(open_, "parent", "created", NOW, "attempts")


@query(f"SELECT count(*) AS queues, CAST(sum(size) AS BIGINT) AS chunks, max(size) AS largest, max(oldest_age) AS oldest_age FROM {_QUEUES}")
def queue_totals(spark, sf_dir):
    return control.queue_totals(control.queue_statistics(chunks(spark, sf_dir).where("status = 'O'"), "parent", "created", NOW))


@query(f"SELECT c.chunk, c.framework, w.client FROM {CHUNKS_SQL} c JOIN (SELECT framework, min(client) AS client FROM (SELECT c_custkey AS client, c_mktsegment AS framework FROM customer) GROUP BY framework) w ON w.framework = ['AUTOMOBILE', 'BUILDING', 'FURNITURE', 'MACHINERY', 'HOUSEHOLD'][c.chunk % 5 + 1] WHERE c.status = 'O'".replace("c.chunk, c.framework", "c.chunk, w.framework"))
def first_workers(spark, sf_dir):
    segments = F.array(*[F.lit(x) for x in ("AUTOMOBILE", "BUILDING", "FURNITURE", "MACHINERY", "HOUSEHOLD")])
    open_ = chunks(spark, sf_dir).where("status = 'O'").select("chunk", F.element_at(segments, (F.col("chunk") % 5 + 1).cast("int")).alias("framework"))
    workers = load(spark, sf_dir, "customer").select(F.col("c_custkey").alias("client"), F.array("c_mktsegment").alias("frameworks"))
    return control.first_workers(workers, open_)


# projections


@query(f"""SELECT c_custkey AS id, c_name AS label, coalesce(n, 0) AS total_chunks, coalesce(active, 0) AS active, CASE WHEN coalesce(n, 0) = 0 THEN 'empty' WHEN active = 0 THEN 'complete' ELSE 'active' END AS status
FROM customer LEFT JOIN (SELECT parent, count(*) AS n, CAST(count(*) FILTER (status <> 'F') AS BIGINT) AS active FROM {CHUNKS_SQL} GROUP BY parent) ON parent = c_custkey""")
def workload_list(spark, sf_dir):
    work = chunks(spark, sf_dir).groupBy(F.col("parent").alias("id")).agg(F.count("*").alias("total_chunks"), F.count_if(F.col("status") != "F").alias("active"))
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    listed = load(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("label")).join(work, "id", "left").select("id", "label", zero("total_chunks"), zero("active"))
    return listed.withColumn("status", F.when(F.col("total_chunks") == 0, "empty").when(F.col("active") == 0, "complete").otherwise("active"))


@query("SELECT u.user_id AS client, count(*) AS results, CAST(count(*) FILTER (event_type = 'error') AS BIGINT) AS errors, strftime(max(ts), '%Y-%m-%dT%H:%M:%SZ') AS last_active FROM events u GROUP BY u.user_id")
def client_list(spark, sf_dir):
    return load(spark, sf_dir, "events").groupBy(F.col("user_id").alias("client")).agg(F.count("*").alias("results"), F.count_if(F.col("event_type") == "error").alias("errors"), series.iso(F.max("ts")).alias("last_active"))


# jobs and kernels


@query("SELECT event_id AS idx, CAST(round(value * 100) AS BIGINT) AS v, row_number() OVER (ORDER BY round(value * 100), event_id) AS place FROM events")
def submitted_sort(spark, sf_dir):
    """A job through the engine: distributed sort, assembled in order."""
    engine = Engine(spark)
    data = load(spark, sf_dir, "events").select(F.col("event_id").alias("idx"), F.round(F.col("value") * 100).cast("long").alias("v"))
    return engine.result(engine.submit({"label": "sort", "chunking": "distributed_sort", "assembly": "sorted", "metadata": {"chunk_size": 1024}}, data))


@query(f"SELECT a.i, b.i AS j, CAST(sum(a.v * b.v) AS BIGINT) AS v FROM {CELLS_SQL} a JOIN {CELLS_SQL} b ON a.k = b.k WHERE a.i < 100 AND b.i < 100 GROUP BY ALL")
def submitted_product(spark, sf_dir):
    engine = Engine(spark)
    return engine.result(engine.submit({"chunking": "block_matrix", "assembly": "block_matrix", "metadata": {"tile_rows": 40}}, whole_rows(spark, sf_dir).where(F.col("i") < 100)))


@query("SELECT event_id, CAST(user_id * 2.5 + event_id AS DOUBLE) AS out FROM events")
def custom_kernel(spark, sf_dir):
    """A user's function, registered by name and run by name."""
    registry = built_in()
    registry.kernel("scaled", lambda a, b: a * 2.5 + b, "double")
    return registry.apply(load(spark, sf_dir, "events").select("event_id", "user_id"), "scaled", "user_id", "event_id").select("event_id", "out")


@query("""SELECT * FROM (VALUES ('linear', 'chunking', true), ('block_matrix', 'chunking', false), ('distributed_sort', 'chunking', true), ('curves', 'chunking', true), ('concatenate', 'assembly', true),
    ('sorted', 'assembly', false), ('block_matrix', 'assembly', false), ('first_factor', 'assembly', false), ('all_curves', 'assembly', true)) v(name, kind, ready)""")
def strategy_readiness(spark, sf_dir):
    return built_in().readiness(spark).select("name", "kind", "ready")


@query(f"SELECT process, count(*) AS n, round(quantile_cont(CAST(power AS DOUBLE), 0.5), 4) AS median FROM {SAMPLES_SQL} GROUP BY process")
def median_by_process(spark, sf_dir):
    return sorting.percentile(stored(samples(spark, sf_dir).select("process", "power"), "power"), "process", "power", 50).select("process", "n", F.round("p", 4).alias("median"))
