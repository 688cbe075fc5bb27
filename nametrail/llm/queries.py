"""Registered queries of the training-data operators, and their DuckDB statements."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nametrail.llm.common import WORD, Tables
from corpus_pipeline import KEEP_TAIL, ORACLE_SQL, rated_grade, run
from nametrail.llm.ann import nearest
from nametrail.llm.decontaminate import benchmark_overlaps
from nametrail.llm.hmm import score_texts
from nametrail.llm.lines import drop_common_lines
from nametrail.llm.mixing import balance_sources
from nametrail.llm.near_dup import near_duplicates
from nametrail.llm.periodic import periodic_runs
from nametrail.llm.quality import fit_grades, grade_documents
from nametrail.llm.revisits import resolve_revisits
from nametrail.llm.secrets import BASE_RULES, find_secrets
from nametrail.llm.spelling import spelling_variants
from nametrail.llm.token_files import read_token_files, write_token_files
from nametrail.llm.token_prefix import prefix_token_counts

Query = Callable[[SparkSession, str], DataFrame]

CONTEXT_TOKENS = 4096


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(_table(spark, sf_dir, "embeddings"), every=50, count=5)


def page_captures(pages: DataFrame) -> DataFrame:
    """WARC records of each page: 6 to 16 captures (406 of every 500th page) at later and later
    times, each third one a response, the others revisits of a like URL. The resource changes
    with every fifth capture. All is derived from the page's id, URL and text."""
    page, j = F.col("page_id"), F.col("j")
    many = 6 + F.when(page % 500 == 0, 400).otherwise(page % 11)
    each = pages.withColumn("j", F.explode(F.sequence(F.lit(0).cast("bigint"), many - 1)))
    start = 1_700_000_000 + (page * 7919) % 1_000_003
    version = F.expr("j div 5")
    timed = each.select(
        page, j, "url", F.length("html").alias("size"), (j % 3 == 0).alias("full"),
        (start + j * 30_011 + (page * 31 + j * 7919) % 20_011).alias("ts"),
        (start - 1000 + version * 10).cast("string").alias("changed"),
        F.concat(F.lit('"'), F.substring(F.md5("html"), 1, 16), F.lit("-"), version, F.lit('"')).alias("tag"))
    shown = F.when(page % 7 == 0, F.lit(None)).when(page % 5 == 0, F.lit('"stale"')).otherwise(
        F.concat(F.lit("W/"), "tag"))
    response = F.create_map(
        F.lit("Content-Type"), F.lit("text/html"), F.lit("Server"), F.concat(F.lit("a"), j),
        F.lit("Content-Length"), F.col("size").cast("string"), F.lit("ETag"), F.col("tag"),
        F.lit("Last-Modified"), F.col("changed"), F.lit("Cache-Control"), F.lit("max-age=60"))
    revisit = F.map_filter(F.create_map(
        F.lit("Date"), F.col("ts").cast("string"), F.lit("etag"), shown,
        F.lit("Last-Modified"), F.when(page % 11 == 0, "7").otherwise(F.col("changed")),
        F.lit("Cache-Control"), F.concat(F.lit("max-age="), (page % 100).cast("string")),
        F.lit("Content-Length"), F.lit("0")), lambda k, v: v.isNotNull())
    return timed.select(
        (page * 1000 + j).alias("record_id"),
        F.when(F.col("full"), F.col("url")).otherwise(F.concat("url", F.lit("#again"))).alias("url"), "ts",
        F.when(F.col("full"), "response").otherwise("revisit").alias("kind"),
        F.when(F.col("full"), response).otherwise(revisit).alias("headers"))


def op2_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    resolved = resolve_revisits(page_captures(_table(spark, sf_dir, "pages")))
    lines = F.transform("headers", lambda h: F.concat_ws(": ", h["name"], h["value"]))
    return resolved.select("record_id", "target", "response_id", "verdict",
                           F.array_join(lines, "|").alias("headers"))


OP2_SQL = r"""
with captures as (
  select page_id, url, html,
    unnest(range(6 + case when page_id % 500 = 0 then 400 else page_id % 11 end)) as j from pages),
timed as (
  select page_id, j, page_id * 1000 + j as record_id, j % 3 = 0 as full_, length(html) as size,
    1700000000 + (page_id * 7919) % 1000003 + j * 30011 + (page_id * 31 + j * 7919) % 20011 as ts,
    cast(1700000000 + (page_id * 7919) % 1000003 - 1000 + j // 5 * 10 as varchar) as changed,
    '"' || substr(md5(html), 1, 16) || '-' || j // 5 || '"' as tag,
    regexp_replace(trim(url), '#.*$', '') as plain
  from captures),
parts as (
  select *, lower(regexp_extract(plain, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?]*)', 1)) as host,
    regexp_replace(regexp_replace(plain, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?]*', ''),
      '([?&])(utm_[A-Za-z0-9_]*|ref|fbclid|gclid)=[^&]*', '\1', 'g') as rest
  from timed),
known as (
  select *, ts * 1000000000 + record_id as place,
    regexp_replace(host, ':(80|443)$', '') || regexp_replace(
      regexp_replace(regexp_replace(rest, '([?&])&+', '\1', 'g'), '[?&]+$', ''),
      '/+($|[?])', '\1', 'g') as target
  from parts),
revisits as (
  select *, case when page_id % 7 = 0 then null when page_id % 5 = 0 then '"stale"' else tag end as shown,
    case when page_id % 11 = 0 then '7' else changed end as told from known where not full_),
responses as (select record_id as response_id, target, place, tag as old_tag, changed as old_changed,
  size as old_size, 'a' || j as server from known where full_),
joined as (
  select v.*, r.response_id, r.old_tag, r.old_changed, r.old_size, r.server,
    case when r.response_id is null then 'missing'
      when coalesce(v.shown = r.old_tag, v.told = r.old_changed) then 'matched' else 'mismatched' end as verdict
  from revisits v asof left join responses r on v.target = r.target and v.place > r.place)
select record_id, target, response_id, verdict,
  case when verdict = 'matched' then
    'cache-control: max-age=' || (page_id % 100) || '|content-length: ' || old_size
    || '|content-type: text/html|date: ' || ts || '|etag: '
    || coalesce(case when shown = '"stale"' then shown else 'W/' || shown end, old_tag)
    || '|last-modified: ' || old_changed || '|server: ' || server
  else
    'cache-control: max-age=' || (page_id % 100) || '|content-length: 0|date: ' || ts
    || coalesce('|etag: ' || case when shown = '"stale"' then shown else 'W/' || shown end, '')
    || '|last-modified: ' || told
  end as headers
from joined
"""


def op3_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(_table(spark, sf_dir, "documents"), percent=85).select(
        "doc_id", "n_shingles", "component_id", "kept")


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = prefix_token_counts(_table(spark, sf_dir, "documents"), "piece_bpe_32k.model")
    return counts.select("doc_id", "n_bytes", "n_tokens",
                         (F.col("n_tokens") > CONTEXT_TOKENS).alias("over_limit"))


def op5_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = write_token_files(_table(spark, sf_dir, "documents"), Tables(spark),
                              "byte_bpe_50k.json", end_id=2)
    return read_token_files(files).select(
        "doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def graded(docs: DataFrame, ratings: DataFrame) -> DataFrame:
    """doc_id, expected_grade, tail and `keep`: the highest grade is at least as likely as not."""
    model = fit_grades(docs, ratings, rated_grade(), n_grades=3)
    return grade_documents(docs, model).withColumn(
        "keep", F.coalesce(F.col("tail") >= KEEP_TAIL, F.lit(True)))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graded(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")).select(
        "doc_id", "expected_grade", "tail", "keep")


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = drop_common_lines(_table(spark, sf_dir, "documents"), least_chars=40, least_docs=5)
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


OP7_SQL = """
with lines as (
  select doc_id, unnest(parts) as line, unnest(range(len(parts))) as i
  from (select doc_id, string_split(coalesce(text, ''), chr(10)) as parts from documents)),
keyed as (
  select *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as key from lines),
common as (
  select key, max(doc_id) as keeper from keyed where length(key) >= 40
  group by key having count(distinct doc_id) >= 5),
marked as (
  select k.*, coalesce(c.keeper <> k.doc_id, false) as gone from keyed k left join common c on k.key = c.key)
select doc_id, count(*) as n_lines, count(*) filter (where gone) as n_dropped,
  sha256(coalesce(string_agg(line, chr(10) order by i) filter (where not gone), '')) as kept_sha256
from marked group by doc_id
"""


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return benchmark_overlaps(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op9_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_secrets(_table(spark, sf_dir, "documents"))
    base = [rule.kind for rule in BASE_RULES]

    def number(kind: str):
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("bigint")

    def joined(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(
            ":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

    return found.select(
        "doc_id", *(number(kind).alias(f"n_{kind}") for kind in base),
        F.sha2(joined(F.filter("spans", lambda s: s["kind"].isin(base))), 256).alias("base_sha256"),
        joined(F.col("spans")).alias("spans"))


def op10_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = balance_sources(_table(spark, sf_dir, "documents"), weights=(3.0, 1.0, 2.0),
                            share=1.5, max_copies=2.0)
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


def op11_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 7 == 2
    return score_texts(_table(spark, sf_dir, "documents"), held_out)


UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Least code points of a word; runs of fewer letters make none.
WORD_LETTERS = 7


def letter_words(docs: DataFrame) -> DataFrame:
    """word, n: runs of letters in lower case; one in 31 by a hash of id and run lacks a letter.

    A null id counts as an empty one.
    """
    runs = docs.select("doc_id", F.explode(F.regexp_extract_all(
        "text", F.lit(f"[A-Za-z\u00c0-\u00ff]{{{WORD_LETTERS},}}"), F.lit(0))).alias("run"))
    lowered = runs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"),
                          F.translate("run", UPPER, LOWER).alias("run"))
    h = F.crc32(F.concat("id", F.lit(":"), "run"))
    hashed = lowered.select("run", h.alias("h"), (h % F.length("run")).cast("int").alias("at"))
    cut = F.concat(F.substring("run", F.lit(1), F.col("at")),
                   F.substring("run", F.col("at") + 2, F.length("run")))
    return (hashed.select(F.when(F.col("h") % 31 == 0, cut).otherwise(F.col("run")).alias("word"))
            .where(F.length("word") >= WORD_LETTERS).groupBy("word").agg(F.count("*").alias("n")))


def op12_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants(letter_words(_table(spark, sf_dir, "documents")), ratio=10,
                             least_length=WORD_LETTERS, least_count=2)


def stretched(docs: DataFrame) -> DataFrame:
    """doc_id and text; every tenth document by the hash of its id repeats a stretch of its words."""
    split = docs.select("doc_id", "text", F.crc32(F.col("doc_id").cast("string")).alias("h")).withColumn(
        "words", F.when(F.col("h") % 10 == 0, F.regexp_extract_all("text", F.lit(WORD), F.lit(0))))
    sized = split.withColumn("n", F.size("words")).withColumn("g", F.floor(F.col("h") / 10))
    begun = sized.withColumn("a", F.when(F.col("n") > 0, F.expr("cast(g % n as int)")))
    shape = begun.withColumn("p", F.expr("cast(1 + (n - a) div (3 + g % 8) as int)"))
    repeated = F.expr("array_join(concat(slice(words, 1, a), slice(flatten(array_repeat("
                      "slice(words, a + 1, p), cast((n - a) div p + 1 as int))), 1, n - a)), ' ')")
    return shape.select("doc_id", F.when(F.col("n") > 0, repeated).otherwise(F.col("text")).alias("text"))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic_runs(stretched(_table(spark, sf_dir, "documents")))
    longest = F.array_max(F.transform("runs", lambda r: F.struct(
        r["length"].alias("length"), (-r["start"]).alias("back"), (-r["period"]).alias("shorter"))))
    lines = F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"]))
    told = found.withColumns({"longest": longest, "lines": F.concat(
        F.array_join(lines, "\n"), F.when(F.size("runs") > 0, "\n").otherwise(""))})
    length, period = F.col("longest.length"), -F.col("longest.shorter")
    return told.select(
        "doc_id", F.size("runs").cast("bigint").alias("n_runs"), (-F.col("longest.back")).alias("start"),
        length.alias("length"), period.alias("period"),
        F.floor(1000 * length / period).alias("exponent_milli"),
        F.sha2("lines", 256).alias("runs_sha256"),
        F.sha2("collapsed_text", 256).alias("collapsed_sha256"))


#: Entries of the table for crc32, and the hash of a list of bytes by it.
CRC_TABLE = """
crc_table as (select list(entry order by i) as entries from (
  select i, list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0],
    lambda c, x: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end) as entry
  from (select unnest(range(256)) as i)))"""


def crc_sql(octets: str) -> str:
    return (f"xor(4294967295, list_reduce(list_concat([4294967295], {octets}), "
            "lambda c, b: xor(c >> 8, entries[1 + (xor(c, b) & 255)])))")


DIGITS = "list_transform(string_split(cast(doc_id as varchar), ''), lambda x: cast(ascii(x) as bigint))"

OP12_SQL = f"""
with recursive {CRC_TABLE},
runs as (
  select doc_id, translate(run, '{UPPER}', '{LOWER}') as run, count(*) as c
  from (select doc_id, unnest(regexp_extract_all(text, '[A-Za-z\u00c0-\u00ff]+')) as run from documents)
  where length(run) >= 7 group by all),
hashed as (
  select run, c, {crc_sql(f"""list_concat({DIGITS}, [58], flatten(list_transform(string_split(run, ''),
    lambda x: case when unicode(x) < 128 then [cast(unicode(x) as bigint)]
      else [192 + (cast(unicode(x) as bigint) >> 6), 128 + (cast(unicode(x) as bigint) & 63)] end)))""")} as h
  from runs cross join crc_table),
words as (
  select word, cast(sum(c) as bigint) as n from (
    select c, case when h % 31 = 0 then substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2)
      else run end as word from hashed)
  where length(word) >= 7 group by word having sum(c) >= 2),
cuts as (
  select word, i, substr(word, 1, i) || substr(word, i + 2) as rest
  from (select word, unnest(range(length(word))) as i from words)),
near as (
  select a.word, b.word as near from cuts a join cuts b
    on a.i = b.i and a.rest = b.rest and a.word <> b.word
  union select c.word, w.word from cuts c join words w on c.rest = w.word
  union select w.word, c.word from cuts c join words w on c.rest = w.word),
best as (
  select near.word, count(*) as n_near,
    min(struct_pack(minus := -w.n, near := near.near)) as best
  from near join words w on near.near = w.word group by near.word),
told as (
  select w.word, w.n, coalesce(n_near, 0) as n_near,
    case when -best.minus >= 10 * w.n then best.near end as form,
    case when -best.minus >= 10 * w.n then -best.minus end as form_n
  from words w left join best b on w.word = b.word),
chain as (
  select word, word as root from told where form is null
  union all select t.word, c.root from told t join chain c on t.form = c.word)
select t.word, t.form, c.root, t.n, t.n_near, t.form_n from told t join chain c on t.word = c.word
"""

OP13_SQL = f"""
with {CRC_TABLE},
hashed as (
  select doc_id, {crc_sql(DIGITS)} as h,
    coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) as words
  from documents cross join crc_table),
shaped as (
  select *, len(words) as n, h // 10 as g, case when len(words) > 0 then (h // 10) % len(words) end as a
  from hashed),
repeated as (
  select doc_id, n, case when h % 10 = 0 and n > 0 then list_transform(range(n),
    lambda i: words[1 + case when i < a then i else a + (i - a) % (1 + (n - a) // (3 + g % 8)) end])
    else words end as words
  from shaped),
placed as (
  select doc_id, n, unnest(words) as word, unnest(range(n)) as i from repeated),
equal as (
  select x.doc_id, y.i - x.i as q, x.i
  from placed x join placed y on x.doc_id = y.doc_id and x.word = y.word
    and y.i > x.i and 4 * (y.i - x.i) <= x.n),
islands as (
  select doc_id, q, min(i) as s, count(*) + q as length
  from (select *, i - row_number() over (partition by doc_id, q order by i) as island from equal)
  group by doc_id, q, island having count(*) + q >= greatest(6, 4 * q)),
runs as (select doc_id, s, length, min(q) as q from islands group by doc_id, s, length),
told as (
  select doc_id, count(*) as n_runs, arg_max(struct_pack(s := s, length := length, q := q),
      struct_pack(l := length, s := -s, q := -q)) as best,
    string_agg(s || ',' || length || ',' || q || chr(10), '' order by s, q) as lines
  from runs group by doc_id),
gone as (
  select distinct p.doc_id, p.i from placed p join runs r
    on p.doc_id = r.doc_id and p.i >= r.s + r.q and p.i < r.s + r.length),
kept as (
  select doc_id, string_agg(word, ' ' order by i) as text
  from placed p anti join gone g using (doc_id, i) group by doc_id)
select d.doc_id, coalesce(n_runs, 0) as n_runs, best.s as start, best.length as length,
  best.q as period, 1000 * best.length // best.q as exponent_milli,
  sha256(coalesce(lines, '')) as runs_sha256, sha256(coalesce(k.text, '')) as collapsed_sha256
from documents d left join told t on d.doc_id = t.doc_id left join kept k on d.doc_id = k.doc_id
"""


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run(spark, sf_dir)


QUERIES: dict[str, Query] = {
    "op1_nearest": op1_nearest,
    "op2_revisits": op2_revisits,
    "op3_near_dup": op3_near_dup,
    "op4_token_counts": op4_token_counts,
    "op5_token_files": op5_token_files,
    "op6_quality": op6_quality,
    "op7_line_dedup": op7_line_dedup,
    "op8_decontaminate": op8_decontaminate,
    "op9_secrets": op9_secrets,
    "op10_source_mix": op10_source_mix,
    "op11_language_model": op11_language_model,
    "op12_spelling": op12_spelling,
    "op13_periodic_runs": op13_periodic_runs,
    "pipeline": pipeline,
}
SQL: dict[str, str] = {"op2_revisits": OP2_SQL, "op7_line_dedup": OP7_SQL, "op12_spelling": OP12_SQL,
                       "op13_periodic_runs": OP13_SQL} | ({"pipeline": ORACLE_SQL} if ORACLE_SQL else {})
