"""Registered queries of sources, sinks, runs and pictures: what is written is read back and held against SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import config as C
from ..functions import ids, pixels, png
from ..operators import manifest, prompts
from ..session import scratch_folder, ship_package
from ..sources import readers, runlog, runners, snapshots, workbooks, writers
from . import fixtures, oracle
from .queries import MATRIX, _matrix, query

BROKEN = "conv_id % 5 = 0 and turn = 0"


# --- sources and sinks -------------------------------------------------------------------------------------------
def _conversation_lines(spark, sf_dir) -> str:
    """A folder of JSON lines: some broken, some followed by blank ones."""
    t, path = fixtures.table(spark, sf_dir, "conversations"), scratch_folder(spark, "lines")
    line = F.when(F.expr(BROKEN), F.concat(F.lit('{"conv_id": '), F.col("conv_id").cast("string"))).otherwise(F.to_json(F.struct(*t.columns)))
    t.select(F.concat(line, F.when(F.col("conv_id") % 3 == 0, "\n").otherwise(""))).write.text(path)
    return path


@query(f"select conv_id, turn, role, text from conversations where not ({BROKEN})")
def jsonl_scan(spark, sf_dir):
    schema = fixtures.table(spark, sf_dir, "conversations").schema
    return readers.read_jsonl(spark, _conversation_lines(spark, sf_dir), schema).select("conv_id", "turn", "role", "text")


@query(f"""select '{{"conv_id": ' || conv_id::varchar as line from conversations where {BROKEN}""")
def jsonl_malformed_lines(spark, sf_dir):
    schema = fixtures.table(spark, sf_dir, "conversations").schema
    return readers.malformed_lines(spark, _conversation_lines(spark, sf_dir), schema).select(F.col(readers.CORRUPT).alias("line"))


@query(f"with responses as ({oracle.RESPONSES}) select model, image_id, prompt_id, task, format, response, gen_seconds, array_to_string(mc_options, '|') as options from responses")
def responses_folder(spark, sf_dir):
    """Two files of responses, one of them written by two appends, read as one table."""
    folder, r = scratch_folder(spark, "responses"), fixtures.responses(spark, sf_dir)
    for k, name in enumerate(("a", "a", "b")):
        writers.append_json(r.filter(F.col("ord") % 3 == k).drop("ord"), f"{folder}/{name}.jsonl")
    out = readers.read_all_responses(spark, folder)
    return out.select("model", "image_id", "prompt_id", "task", "format", "response", "gen_seconds", F.array_join("mc_options", "|").alias("options"))


EXAM_COLUMNS = "image_id dataset subject_id slice_frac label_modality label_plane label_tumor_present label_laterality is_negative_control slice_tumor_present slice_laterality".split()


@query(f"with m as ({oracle.MANIFEST}) select {', '.join(EXAM_COLUMNS)} from m")
def manifest_csv(spark, sf_dir):
    path, m = scratch_folder(spark, "exam") + ".csv", fixtures.manifest(spark, sf_dir)
    kinds = {f.name: f.dataType for f in readers.MANIFEST.fields}
    writers.write_csv(m.limit(0).select("image_id"), path)  # an older file, to be written over
    writers.write_csv(m.select(*[(F.col(c) if c in m.columns else F.lit(None)).cast(t).alias(c) for c, t in kinds.items()]), path)
    return readers.read_manifest(spark, path).select(*EXAM_COLUMNS)


@query(f"with m as ({oracle.MANIFEST}) select image_id, dataset, v as version from m, (values (0), (1), (2)) as t(v) where v <> 1")
def replaced_table(spark, sf_dir):
    """The backup of a table that was replaced twice (its first version), and its last version."""
    path = scratch_folder(spark, "table")
    writers.replace_table(fixtures.manifest(spark, sf_dir).select("image_id", "dataset", F.lit(0).alias("version")), path)
    for _ in range(2):
        writers.replace_table(spark.read.parquet(path).withColumn("version", F.col("version") + 1), path)
    return spark.read.parquet(f"{path}.bak").unionByName(spark.read.parquet(path))


@query(
    """select 'read' as kind, n as at, case when n = 3 then 1 else n end as version, o_orderkey, o_totalprice::double * case when n = 3 then 1 else n end as price from orders, (values (1), (2), (3)) as t(n)
    union all select 'listed', n, n, null, null from (values (1), (3)) as t(n)"""
)
def snapshot_table(spark, sf_dir):
    """Orders published three times: the backup, a version made from it, the backup restored; then the second expires."""
    path, t = scratch_folder(spark, "snapshots"), fixtures.table(spark, sf_dir, "orders")
    snapshots.publish(t.select("o_orderkey", F.col("o_totalprice").cast("double").alias("price"), F.lit(1).alias("version")), path, expect=0)
    snapshots.publish(snapshots.read(spark, path).withColumns({"price": F.col("price") * 2, "version": F.col("version") + 1}), path, expect=1)
    second = snapshots.read(spark, path)
    snapshots.restore(spark, path, 1)
    rows = [snapshots.read(spark, path, 1), second, snapshots.read(spark, path)]
    out = None
    for n, part in enumerate(rows, 1):
        part = part.select(F.lit("read").alias("kind"), F.lit(n).alias("at"), "version", "o_orderkey", "price")
        out = part if out is None else out.unionByName(part)
    kept = scratch_folder(spark, "snapshots-read")
    out.write.parquet(kept)
    snapshots.expire(spark, path, 0)
    listed = snapshots.history(spark, path).select(F.lit("listed").alias("kind"), F.col("version").cast("int").alias("at"), F.col("version").cast("int").alias("version"))
    return spark.read.parquet(kept).unionByName(listed, allowMissingColumns=True)


@query(
    """select 'ixi' as source, printf('IXI%03d', c_custkey) as subject_id, case c_custkey % 3 when 1 then 'M' when 2 then 'F' end as demo_sex, case when c_acctbal >= 0 then (c_custkey % 90)::double + 0.5 end as demo_age from customer
    union all select 'oasis', printf('OAS%04d', c_custkey), case when c_custkey % 2 = 0 then 'M' else 'F' end, (c_custkey % 90)::double from customer"""
)
def demographics(spark, sf_dir):
    """Two demographic tables with headers of their own, from CSV."""
    t, k = fixtures.table(spark, sf_dir, "customer"), F.col("c_custkey")
    ixi, oasis = scratch_folder(spark, "ixi"), scratch_folder(spark, "oasis")
    age = F.when(F.col("c_acctbal") >= 0, ((k % 90).cast("double") + 0.5).cast("string")).otherwise("n/a")
    t.select(k.alias("ixi_id "), (k % 3).alias("Sex_id (1=m, 2=f)"), age.alias("Age")).write.option("header", True).csv(ixi)
    t.select(F.format_string("OAS%04d", k.cast("long")).alias("id"), F.when(k % 2 == 0, "M").otherwise("F").alias("M/F"), (k % 90).alias("age")).write.option("header", True).csv(oasis)
    read = lambda path: spark.read.option("header", True).csv(path)
    one, two = readers.ixi_demographics(read(ixi)), readers.oasis_demographics(read(oasis))
    return one.select(F.lit("ixi").alias("source"), "*").unionByName(two.select(F.lit("oasis").alias("source"), "*"))


@query("""select printf('IXI%03d', c_custkey) as subject_id, case c_custkey % 3 when 1 then 'M' when 2 then 'F' end as demo_sex, case when c_acctbal >= 0 then (c_custkey % 90)::double + 0.5 end as demo_age from customer""")
def demographics_workbook(spark, sf_dir):
    """Demographics of spreadsheets: numbers as numbers, unknown ages as text, over several workbooks."""
    t, k, path = fixtures.table(spark, sf_dir, "customer"), F.col("c_custkey"), scratch_folder(spark, "workbooks")
    sheet = t.select(k.alias(" ixi_id"), (k % 3).alias("Sex_id (1=m, 2=f)"), F.when(F.col("c_acctbal") >= 0, (k % 90).cast("double") + 0.5).alias("Age"), F.lit("n/a").alias("note"))
    workbooks.register(spark)
    sheet.repartition(3, " ixi_id").write.format("workbook").mode("overwrite").save(path)
    return readers.ixi_demographics(workbooks.read_workbook(spark, path))


@query(
    """select o_orderkey, o_orderdate::date::varchar as day, round(o_totalprice::double, 2) as price, case when o_orderkey % 3 > 0 then o_orderpriority || ' <&> ' || (o_orderkey % 20000)::varchar end as note, o_orderkey % 2 = 0 as even,
      strftime(o_orderdate::date, '%Y-%m-%d') || printf(' %02d:30:15', (o_orderkey % 24)::int) as moment from orders"""
)
def workbook_round_trip(spark, sf_dir):
    """Orders as workbooks: dates, times, numbers, truth values, shared and single texts, blanks."""
    t, path = fixtures.table(spark, sf_dir, "orders"), scratch_folder(spark, "orders")
    key, day = F.col("o_orderkey"), F.col("o_orderdate").cast("date")
    note = F.when(key % 3 > 0, F.concat("o_orderpriority", F.lit(" <&> "), (key % 20000).cast("string")))
    moment = F.concat_ws(" ", day.cast("string"), F.format_string("%02d:30:15", (key % 24).cast("int"))).cast("timestamp_ntz")
    workbooks.register(spark)
    t.select(key, day.alias("day"), F.round(F.col("o_totalprice").cast("double"), 2).alias("price"), note.alias("note"), (key % 2 == 0).alias("even"), moment.alias("moment")).write.format("workbook").mode("append").save(path)
    got = workbooks.read_workbook(spark, path, schema="o_orderkey long, day date, price double, note string, even boolean, moment string")
    return got.withColumn("day", F.col("day").cast("string"))


NUMBER = "lpad(cast(p_partkey as varchar(20)), 9, '0')"
PATHS_SQL = f"""select 'brats' as dataset, concat('/d/BraTS_', {NUMBER}, '/BraTS_', {NUMBER}, '_', case p_partkey % 6 when 0 then 't1' when 1 then 't1ce' when 2 then 't2' when 3 then 'flair' when 4 then 'seg' else 'T1N' end, '.nii.gz') as path from {{part}}
union all select 'ixi', concat('/d/IXI', {NUMBER}, '-Guys-', case p_partkey % 6 when 0 then 'T1' when 1 then 'T2' when 2 then 'PD' when 3 then 'MRA' when 4 then 'DTI' else 'XX' end, '.nii.gz') from {{part}}
union all select 'oasis', concat('/d/OAS', {NUMBER}, '_MR1.nii.gz') from {{part}}"""


def _paths(spark, sf_dir):
    return spark.sql(PATHS_SQL, part=fixtures.table(spark, sf_dir, "part"))


@query(
    f"""with p as ({PATHS_SQL.format(part='part')}), k as (select p_partkey as k, {NUMBER} as n from part)
    select 'brats' as dataset, concat('BraTS_', n) as subject_id, case k % 6 when 0 then 'T1' when 1 then 'T1ce' when 2 then 'T2' when 3 then 'FLAIR' else 'T1' end as modality from k where k % 6 <> 4
    union all select 'ixi', concat('IXI', n), case k % 6 when 0 then 'T1' when 1 then 'T2' when 2 then 'PD' when 3 then 'MRA' else 'DWI' end from k where k % 6 <> 5
    union all select 'oasis', concat('OAS', n), 'T1' from k"""
)
def volume_discovery(spark, sf_dir):
    found = None
    for name in ("brats", "ixi", "oasis"):
        paths = _paths(spark, sf_dir).filter(F.col("dataset") == name).select("path")
        part = readers.discover(paths, name, strict_subjects=True).select(F.lit(name).alias("dataset"), "subject_id", "modality")
        found = part if found is None else found.unionByName(part)
    return found


@query(f"with p as ({PATHS_SQL.format(part='part')}) select string_split(path, '/')[-1] as subject_id, path from p where dataset = 'brats' and path not like '%seg%'")
def volume_discovery_by_name(spark, sf_dir):
    """The default: the last part of the path that looks like a subject is the file itself."""
    return readers.discover(_paths(spark, sf_dir).filter("dataset = 'brats'").select("path"), "brats").select("subject_id", "path")


@query(f"with p as ({PATHS_SQL.format(part='part')}) select path as mask_path, regexp_extract(path, '^(.*)/[^/]*$', 1) as folder from p where path like '%seg.nii.gz'")
def segmentation_lookup(spark, sf_dir):
    return readers.segmentation_files(_paths(spark, sf_dir).select("path"))


@query(
    """select format('nc_{}_{:04d}', kind, i) as image_id, kind as negative_control_type, 4096 as n, true as in_range, case kind when 'zeros' then 1 when 'salt_pepper' then 2 end as n_values
    from (values ('gaussian', 6), ('salt_pepper', 6), ('blurred_uniform', 6), ('zeros', 2)) as k(kind, n), range(6) as r(i) where i < n"""
)
def noise_controls(spark, sf_dir):
    df = readers.noise_controls(spark, {"gaussian": 6, "salt_pepper": 6, "blurred_uniform": 6, "zeros": 2})
    few = F.when(F.col("negative_control_type").isin("zeros", "salt_pepper"), F.size(F.array_distinct("pixels")))
    return df.select("image_id", "negative_control_type", F.size("pixels").alias("n"), F.forall("pixels", lambda v: v.between(0, 255)).alias("in_range"), few.alias("n_values"))


# --- pictures ----------------------------------------------------------------------------------------------------
@query(
    """with p as (select vec_id, list_transform(embedding, lambda v: cast(floor(abs(v::double) * 1000) as int) % 256) as x from embeddings)
    select vec_id, 8 as width, (len(x) // 8)::int as height, list_sum(x)::bigint as total, list_sum(list_transform(x, lambda v, i: v * i))::bigint as placed, '{"vec_id":' || vec_id::varchar || '}' as note, 'iVBORw0KGgo=' as head from p"""
)
def png_round_trip(spark, sf_dir):
    """Vectors as pictures with their provenance, encoded, stored and decoded."""
    ship_package(spark)
    path, t = scratch_folder(spark, "pictures"), fixtures.table(spark, sf_dir, "embeddings")
    grey = F.transform("embedding", lambda v: (F.floor(F.abs(v.cast("double")) * 1000.0).cast("int") % 256))
    t.select("vec_id", png.to_png(grey, F.lit(8), F.to_json(F.struct("vec_id"))).alias("content")).write.parquet(path)
    got = spark.read.parquet(path).withColumn("p", png.from_png(F.col("content")))
    total = lambda a: F.aggregate(a, F.lit(0).cast("long"), lambda s, v: s + v)
    placed = F.transform("p.pixels", lambda v, i: v * (i + 1))
    return got.select("vec_id", "p.width", "p.height", total(F.col("p.pixels")).alias("total"), total(placed).alias("placed"), "p.note", F.base64(F.substring("content", 1, 8)).alias("head"))


@query(
    f"""with m as (select vec_id, case vec_id % 3 when 0 then 'axial' when 1 then 'coronal' else 'sagittal' end as plane, vec_id % 100 as i,
      len(list_filter(embedding, lambda v, j: v > 0 and (j - 1) % 8 > 3))::double as r, len(list_filter(embedding, lambda v: v > 0)) as n from embeddings)
    select vec_id, case when n = 0 then 'none' when plane = 'sagittal' then case when i > 50 then 'right' else 'left' end when r / n >= {C.SIDE_SHARE!r}::double then 'right' when 1 - r / n >= {C.SIDE_SHARE!r}::double then 'left' else 'bilateral' end as side from m"""
)
def plane_laterality(spark, sf_dir):
    t = fixtures.table(spark, sf_dir, "embeddings")
    mask = F.transform("embedding", lambda v: (v > 0).cast("int"))
    right, total = pixels.side_share(mask, lambda i: i % 8, F.lit(3))
    plane = F.element_at(F.array(F.lit("axial"), F.lit("coronal"), F.lit("sagittal")), (F.col("vec_id") % 3 + 1).cast("int"))
    return t.select("vec_id", pixels.slice_laterality(plane, F.col("vec_id") % 100, F.lit(50), right, total).alias("side"))


@query(
    f"""with m as ({oracle.MANIFEST}), k as (select image_id, right(image_id, 6)::int as k, slice_tumor_present as p, slice_laterality as s from m)
    select image_id, case when k % 4 = 3 then 'unknown' when p = 'yes' and k % 120 < {C.AREA_THRESHOLD_PX} then 'no' else p end as slice_tumor_present, case when k % 4 = 3 then -1 else k % 120 end as slice_tumor_area_px,
      case when k % 4 = 3 then 'unknown' when p = 'yes' and k % 120 < {C.AREA_THRESHOLD_PX} then 'none' else s end as slice_laterality from k"""
)
def slice_label_join(spark, sf_dir):
    """Labels of three images in four, joined to the exam with the threshold of areas."""
    m, k = fixtures.manifest(spark, sf_dir), F.substring("image_id", 5, 6).cast("int")
    area = (k % 120).cast("int")
    slices = m.filter(k % 4 != 3).select("image_id", "slice_tumor_present", area.alias("slice_tumor_area_px"), (area.cast("double") / 4096.0).alias("slice_tumor_area_frac"), "slice_laterality")
    return manifest.with_slice_labels(m, slices).select("image_id", "slice_tumor_present", "slice_tumor_area_px", "slice_laterality")


@query("select item_id, left(sha256(text), 16) as prefix from benchmark")
def content_prefixes(spark, sf_dir):
    return fixtures.table(spark, sf_dir, "benchmark").select("item_id", ids.content_prefix(F.col("text").cast("binary")).alias("prefix"))


# --- runs --------------------------------------------------------------------------------------------------------
PROMPT_ID = "concat_ws('__', image_id, task, phrasing, fmt)"
MD5_MOD = "list_reduce([0::bigint] || [cast(('0x' || c)::ubigint as bigint) for c in regexp_extract_all(md5(image_id || '|' || prompt_id), '.')], lambda a, c: (a * 16 + c) % 4)"


@query(f"{MATRIX} select {PROMPT_ID} as prompt_id, '/img/' || image_id || '.png' as image_path from l where right(image_id, 6)::int % 5 <> 1")
def prompts_with_images(spark, sf_dir):
    """An image in five has an empty path and one in ten none: their prompts go."""
    k = F.substring("image_id", 5, 6).cast("int") % 10
    exam = fixtures.manifest(spark, sf_dir).withColumn("path", F.when(k == 1, "").when(k != 6, F.concat(F.lit("/img/"), "image_id", F.lit(".png"))))
    return prompts.with_images(_matrix(spark, sf_dir), exam).select("prompt_id", "image_path")


@query(f"{MATRIX}, q as (select image_id, {PROMPT_ID} as prompt_id from l) select prompt_id from q where {MD5_MOD} = 1 order by prompt_id limit 50")
def prompt_shard_limit(spark, sf_dir):
    return prompts.shard(_matrix(spark, sf_dir), 1, 4, limit=50).select("prompt_id")


@query(
    "with r as (select * from (values "
    + ", ".join(f"({i}, {oracle.lit(r[0])}, {r[6]}, {r[7]})" for i, r in enumerate(fixtures.REGISTRY_ROWS))
    + f""") as t(i, id, optional, ablation)) select 'default' as how, id from r where not optional and not ablation union all select 'all', id from r
    union all select 'one', id from r where id = {oracle.lit(fixtures.REGISTRY_ROWS[4][0])} union all select 'third', id from (select id, row_number() over (order by i) as n from r where not optional and not ablation) where n = 3"""
)
def model_selection(spark, sf_dir):
    registry = fixtures.registry(spark)
    ways = {"default": {}, "all": {"optional": True, "ablation": True}, "one": {"model": fixtures.REGISTRY_ROWS[4][0]}, "third": {"index": 2}}
    out = None
    for how, options in ways.items():
        part = runners.select_models(registry, **options).select(F.lit(how).alias("how"), "id")
        out = part if out is None else out.unionByName(part)
    return out


@query(
    """with o as (select count(*) as n, count(*) filter (where o_orderpriority = '1-URGENT') as urgent, sum(o_orderkey)::bigint as keys from orders)
    select name, kind, n as rows, n as counted, urgent, keys, 0::double as remaining_seconds from o, (values ('written', 'batch'), ('copied', 'stream')) as t(name, kind)"""
)
def run_metrics(spark, sf_dir):
    """What a batch and a stream tell of themselves while they write orders, with a sink that fails at each record."""
    t, path = fixtures.table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority"), scratch_folder(spark, "runs")
    counts = {"urgent": F.count_if(F.col("o_orderpriority") == "1-URGENT"), "keys": F.sum("o_orderkey")}

    def fails(record):
        raise OSError("no room")

    log = runlog.RunLog(runlog.table_sink(spark, f"{path}/log"), fails)
    log.run("written", t, lambda df: df.write.parquet(f"{path}/orders"), total=t.count(), **counts)
    with log.streams(spark):
        arrivals = runlog.observed(spark.readStream.schema(t.schema).option("maxFilesPerTrigger", 4).parquet(f"{path}/orders"), "orders", **counts)
        writer = arrivals.writeStream.queryName("copied").trigger(availableNow=True).option("checkpointLocation", f"{path}/checkpoint")
        writer.format("parquet").start(f"{path}/copy").awaitTermination()
    records = spark.read.schema(runlog.RECORDS).json(f"{path}/log")
    told = lambda name: F.coalesce(F.get_json_object("metrics", f"$.orders.{name}"), F.get_json_object("metrics", f"$.{name}")).cast("long")
    counted = F.when(F.col("kind") == "batch", F.col("rows")).otherwise(told("rows"))
    total = lambda c, name: F.sum(c).alias(name)
    left = F.coalesce(F.max("remaining_seconds"), F.lit(0.0)).alias("remaining_seconds")
    return records.groupBy("name", "kind").agg(total("rows", "rows"), total(counted, "counted"), total(told("urgent"), "urgent"), total(told("keys"), "keys"), left)


WORDS = "Cases:\n", "{number}) {question} -> {label} ({confidence})", "\nNow:\n"


@query(
    """select item_id, 'Cases:' || chr(10) || '1) ' || left(text, 200) || ' -> yes (90)' || chr(10) || '2) short -> ' || (item_id % 4)::varchar || ' (' || (item_id % 100)::varchar || ')' || chr(10) || 'Now:' || chr(10) as prefix from benchmark"""
)
def few_shot_prefix(spark, sf_dir):
    case = lambda q, a, c: F.struct(q.alias("prompt_text"), a.alias("label"), c.cast("int").alias("confidence"))
    item = F.col("item_id")
    cases = F.array(case(F.col("text"), F.lit("yes"), F.lit(None)), case(F.lit("short"), (item % 4).cast("string"), item % 100), case(F.lit("cut"), F.lit("no"), F.lit(1)))
    return fixtures.table(spark, sf_dir, "benchmark").select("item_id", prompts.few_shot_prefix(cases, 2, WORDS).alias("prefix"))
