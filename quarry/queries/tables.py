"""Loading, cleaning, export, retrieval and text-table jobs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions.text import extract_json, strip_reasoning
from quarry.operators import clean as C
from quarry.operators import profile as P
from quarry.operators import retrieval as R
from quarry.operators.text_index import TextIndex
from quarry.plans.flat import flat, table
from quarry.queries.plans import labelled
from quarry.queries.profiles import LABELLED, ROLES, source
from quarry.queries.registry import ORACLES, query, register
from quarry.sources import delimited as D
from quarry.sources import export as E
from quarry.sources import folders
from quarry.sources.shared import new_folder


def messy(spark, sf):
    """Orders as a badly exported file would have them: every column a text, in mixed styles by the order's number."""
    kind = F.col("o_orderkey") % 4
    price = F.col("o_totalprice").cast("decimal(14,2)")
    return table(spark, sf, "orders").select(
        F.row_number().over(Window.partitionBy("o_orderkey").orderBy("o_custkey")).cast("string").alias("copy"),
        F.col("o_orderkey").cast("string").alias(" Order \n Key "),
        F.when(kind == 0, F.concat(F.lit("$"), F.format_number(price, 2))).when(kind == 1, F.concat(F.lit("("), F.format_number(price, 2), F.lit(")"))).when(kind == 2, F.concat(price.cast("string"), F.lit(" %"))).otherwise(price.cast("string")).alias("Price"),
        F.when(kind == 0, F.date_format("o_orderdate", "yyyy-MM-dd")).when(kind == 1, F.date_format("o_orderdate", "M/d/yyyy")).when(kind == 2, F.date_format("o_orderdate", "MMM d, yyyy")).otherwise(F.date_format("o_orderdate", "yyyy/M/d")).alias("order date"),
        F.concat((F.col("o_custkey") % 100).cast("string"), F.lit("D")).alias("code"),
        F.when(kind == 0, F.concat(F.lit("  "), "o_orderstatus", F.lit("\t"))).when(kind == 1, " NULL ").when(kind == 2, "nan").otherwise(F.col("o_orderstatus")).alias("Status"),
        F.col("o_orderpriority").alias("status"),
        F.lit(None).cast("string").alias(""),
    ).drop("copy")


SIGNED = "case when o_orderkey % 4 = 1 then -1 else 1 end * cast(cast(o_totalprice as decimal(14,2)) as double)"
STATUS = "case when o_orderkey % 4 in (0, 3) then o_orderstatus end"


@query(f"select o_orderkey, {SIGNED} as number from orders")
def clean_numbers(spark, sf):
    return messy(spark, sf).select(F.col("` Order \n Key `").cast("long").alias("o_orderkey"), C.as_number(F.col("Price")).alias("number"))


@query("select o_orderkey, cast(null as double) as number from orders")
def clean_codes_stay(spark, sf):
    return messy(spark, sf).select(F.col("` Order \n Key `").cast("long").alias("o_orderkey"), C.as_number(F.col("code")).alias("number"))


@query("select o_orderkey, strftime(o_orderdate, '%Y-%m-%d') as day from orders")
def clean_dates(spark, sf):
    return messy(spark, sf).select(F.col("` Order \n Key `").cast("long").alias("o_orderkey"), F.date_format(C.as_date(F.col("order date")), "yyyy-MM-dd").alias("day"))


@query(f"select o_orderkey, {STATUS} as status from orders")
def clean_trim(spark, sf):
    named = messy(spark, sf)
    named = named.toDF(*C.tidy_names(named.columns))
    return named.select(F.col("`Order Key`").cast("long").alias("o_orderkey"), C.trimmed(F.col("Status")).alias("status"))


@query("""select * from (values ('Order Key', 'number'), ('Price', 'number'), ('order date', 'date'), ('code', 'keep'), ('Status', 'keep'), ('status (1)', 'keep'), ('unnamed', 'drop')) v("column", decision)""")
def clean_decisions(spark, sf):
    named = messy(spark, sf)
    return C.column_facts(named.toDF(*C.tidy_names(named.columns))).select("column", C.decisions().alias("decision"))


@query("select 'Order Key' as column, count(*) as present from orders union all select 'Price', count(*) from orders union all select 'order date', count(*) from orders union all select 'code', count(*) from orders union all select 'Status', count(*) from orders union all select 'status (1)', count(*) from orders union all select 'unnamed', 0 from orders having count(*) >= 0")
def clean_names(spark, sf):
    named = messy(spark, sf)
    return C.column_facts(named.toDF(*C.tidy_names(named.columns))).select("column", "present")


@query(f"select toxic, quality from {LABELLED} where toxic is not null or quality is not null")
def clean_empty_rows(spark, sf):
    return C.drop_empty_rows(labelled(spark, sf).select("toxic", "quality"))


@query("select o_orderkey, o_orderstatus from orders")
def clean_index_column(spark, sf):
    rows = table(spark, sf, "orders").select(F.col("o_orderkey").alias("Unnamed: 0"), "o_orderkey", "o_orderstatus")
    return C.drop_index_columns(rows)[0]


@query("select distinct user_id, event_type, props from events")
def clean_duplicates(spark, sf):
    return C.drop_duplicate_rows(table(spark, sf, "events").select("user_id", "event_type", "props"))


@query(f"select o_orderkey * 1.0::double as order_key, {SIGNED} as price, strftime(o_orderdate, '%Y-%m-%d') as day, cast(o_custkey % 100 as varchar) || 'D' as code, {STATUS} as status, o_orderpriority as priority from orders")
def clean_all(spark, sf):
    out, _ = C.clean(messy(spark, sf))
    return out.select(F.col("`Order Key`").alias("order_key"), F.col("Price").alias("price"), F.date_format(F.col("`order date`"), "yyyy-MM-dd").alias("day"), "code", F.col("Status").alias("status"), F.col("`status (1)`").alias("priority"))



@query("select o_orderkey, strftime(o_orderdate, '%Y-%m-%d') as day, strftime(o_orderdate, '%Y-%m-%d') as other from orders")
def clean_day_first(spark, sf):
    """Both readings fit most of these dates; the few that fit one alone decide for their whole column."""
    rows = table(spark, sf, "orders").select(F.col("o_orderkey").cast("string").alias("o_orderkey"), F.date_format("o_orderdate", "d/M/yyyy").alias("day"), F.date_format("o_orderdate", "MM/dd/yyyy").alias("other date"))
    out, _ = C.clean(rows)
    return out.select(F.col("o_orderkey").cast("long").alias("o_orderkey"), F.date_format("day", "yyyy-MM-dd").alias("day"), F.date_format(F.col("other date"), "yyyy-MM-dd").alias("other"))


@query("""with e as (select user_id, event_type, props from events), g as (select count(*) as n from e group by user_id, event_type, props)
select 'before' as stage, cast(sum(n) as bigint) as rows, cast(3 as bigint) as columns, cast(0 as bigint) as missing, cast(sum(n - 1) as bigint) as duplicates from g
union all select 'after', count(*), cast(3 as bigint), cast(0 as bigint), cast(0 as bigint) from g""")
def clean_report(spark, sf):
    rows = table(spark, sf, "events").select("user_id", "event_type", "props")
    after = C.drop_duplicate_rows(rows)
    return C.size_facts(rows).select(F.lit("before").alias("stage"), "*").unionByName(C.size_facts(after).select(F.lit("after").alias("stage"), "*"))


@query(f"select 'toxic is ' || cast(round(100 * (1 - count(toxic) / count(*))) as integer) || '% empty' as warning from {LABELLED} having count(toxic) < 0.5 * count(*) union all select 'quality is ' || cast(round(100 * (1 - count(quality) / count(*))) as integer) || '% empty' from {LABELLED} having count(quality) < 0.5 * count(*)")
def clean_warnings(spark, sf):
    rows = labelled(spark, sf).select("doc_id", "toxic", "quality")
    row = rows.agg(F.count("*").alias("n"), *(F.avg(F.col(c).isNull().cast("int")).alias(c) for c in rows.columns)).first()
    said = C.warnings(row["n"], 3, {c: row[c] for c in rows.columns})
    return spark.createDataFrame([(w,) for w in said], "warning string")


# Delimited and JSON data.

SEPARATOR = {"F": ";", "O": "|", "P": "\t"}


def lines(spark, sf):
    """Delimited lines, one layout for each order status, with quoted fields that hold the separator."""
    s = F.element_at(F.create_map(*(F.lit(x) for p in SEPARATOR.items() for x in p)), F.col("o_orderstatus"))
    return table(spark, sf, "orders").select(F.col("o_orderstatus").alias("file"), F.concat_ws("", F.col("o_orderkey").cast("string"), s, F.lit('"'), "o_orderpriority", F.lit('"'), s, F.lit(" $1"), F.lit(",000"), s, F.col("o_custkey").cast("string")).alias("line"))


@query("select o_orderstatus as file, case o_orderstatus when 'F' then ';' when 'O' then '|' else chr(9) end as separator from orders group by 1, 2")
def sniff_separators(spark, sf):
    return D.separator_scores(lines(spark, sf))


@query("select cast(o_orderkey as varchar) as key, 'of ;' || o_orderpriority as priority, '$1,000' as amount, cast(o_custkey as varchar) as customer from orders")
def parse_lines(spark, sf):
    raw = table(spark, sf, "orders").select(F.concat(F.col("o_orderkey").cast("string"), F.lit(';"of ;'), "o_orderpriority", F.lit('"; $1,000;'), F.col("o_custkey").cast("string")).alias("line"))
    return raw.select(D.parsed(F.col("line"), "key string, priority string, amount string, customer string", ";").alias("r")).select("r.*")


def folder_of_layouts(spark, sf):
    """Orders as a folder of files: one layout for each status, in other encodings, column orders and spellings; the notes hold quotes, separators and line ends."""
    path = new_folder(spark, "layouts")
    rows = table(spark, sf, "orders")
    key, priority, customer = F.col("o_orderkey").cast("string"), F.col("o_orderpriority"), F.col("o_custkey").cast("string")
    place = F.concat(F.lit("Orléans, quai "), customer)
    write = lambda df, status, **how: df.write.csv(f"{path}/{status}", header=True, quote='"', escape='"', **how)
    write(rows.where("o_orderstatus = 'F'").select(key.alias("Order Key"), priority.alias("Priority"), place.alias("Place")), "F", sep=";")
    write(rows.where("o_orderstatus = 'O'").select(place.alias("place"), customer.alias("Customer.No"), key.alias(" order  key ")), "O", sep=",", encoding="ISO-8859-1")
    note = F.concat(F.lit('said "'), priority, F.lit('"\nand\t'), customer)
    write(rows.where("o_orderstatus = 'P'").select(customer.alias("Customer.No"), note.alias("Note"), key.alias("Order Key")), "P", sep="\t")
    spark.createDataFrame([], "x string").write.text(f"{path}/none")
    return path


@query("""select cast(o_orderkey as varchar) as order_key, case when o_orderstatus = 'F' then o_orderpriority end as priority, case when o_orderstatus in ('F', 'O') then 'Orléans, quai ' || o_custkey end as place,
case when o_orderstatus in ('O', 'P') then cast(o_custkey as varchar) end as customer, case when o_orderstatus = 'P' then 'said "' || o_orderpriority || '"' || chr(10) || 'and' || chr(9) || o_custkey end as note from orders""")
def read_folder(spark, sf):
    rows, _ = folders.read_folder(spark, folder_of_layouts(spark, sf), on_problem="skip")
    return rows.select(F.col("`Order Key`").alias("order_key"), F.col("Priority").alias("priority"), F.col("Place").alias("place"), F.col("`Customer.No`").alias("customer"), F.col("Note").alias("note"))


@query("""select o_orderstatus as status, case o_orderstatus when 'F' then ';' when 'O' then ',' else chr(9) end as separator, o_orderstatus <> 'O' as utf8, o_orderstatus = 'P' as over_lines,
case o_orderstatus when 'F' then 'Order Key;Priority;Place' when 'O' then 'place,Customer.No,order  key' else 'Customer.No' || chr(9) || 'Note' || chr(9) || 'Order Key' end as header, cast(null as varchar) as problem from orders group by o_orderstatus
union all select 'none', ',', null, null, null, 'no bytes'""")
def folder_verdicts(spark, sf):
    judged = folders.verdicts(spark, folder_of_layouts(spark, sf))
    status = F.regexp_extract("file", "/([^/]+)/[^/]+$", 1)
    return judged.where("problem is null or bytes = 0").select(status.alias("status"), "separator", "utf8", "over_lines", F.trim(F.replace("header", F.lit('"'), F.lit(""))).alias("header"), "problem").distinct()


@query("select o_orderstatus as file, false as over_lines from orders group by 1")
def lines_with_open_quotes(spark, sf):
    return D.odd_quotes(lines(spark, sf))


@query("select doc_id, md5(text) as digest from documents")
def decode_files(spark, sf):
    raw = table(spark, sf, "documents").select("doc_id", F.col("lang").alias("file"), F.when(F.col("lang") == "fr", F.encode("text", "ISO-8859-1")).otherwise(F.col("text").cast("binary")).alias("raw"))
    return raw.join(D.utf8_files(raw), "file").select("doc_id", F.md5(D.decoded(F.col("raw"), F.col("utf8")).cast("binary")).alias("digest"))


@query("select * from orders where (o_custkey, o_orderkey) > (500, 0) order by o_custkey, o_orderkey limit 100")
def rows_page(spark, sf):
    return E.page(table(spark, sf, "orders"), ["o_custkey", "o_orderkey"], after=[500, 0])


@query(f"""select *, (select count(*) from documents) as total from (select doc_id, lang, toxic, verdict from {LABELLED}) order by toxic nulls first, lang,
md5(concat_ws(chr(31), 'v' || doc_id, coalesce('v' || lang, 'n'), coalesce('v' || toxic, 'n'), coalesce('v' || verdict, 'n'))) limit 300 offset 600""")
def rows_third_page(spark, sf):
    """By keys that are null or shared by many rows."""
    rows = labelled(spark, sf).select("doc_id", "lang", "toxic", "verdict")
    after = None
    for _ in range(3):
        page = E.read_page(rows, ["toxic", "lang"], after, size=300)
        after = page.after
    return spark.createDataFrame(page.rows, rows.schema).withColumn("total", F.lit(page.total).cast("long"))


@query("""select doc_id, md5(cast(doc_id as varchar) || ',' || lang || ',' || case when regexp_matches(text, '[",\n\r]') then '"' || replace(text, '"', '""') || '"' else text end) as digest from documents""")
def csv_export(spark, sf):
    docs = table(spark, sf, "documents")
    return docs.select("doc_id", F.md5(E.csv_lines(docs, ["doc_id", "lang", "text"]).cast("binary")).alias("digest"))


@query(f"select doc_id, '{{\"doc_id\":' || doc_id || ',\"lang\":\"' || lang || '\",\"toxic\":' || coalesce(cast(toxic as varchar), 'null') || '}}' as json from {LABELLED}")
def json_export(spark, sf):
    rows = labelled(spark, sf)
    return rows.select("doc_id", E.json_rows(rows, ["doc_id", "lang", "toxic"]).alias("json"))


@query("""select count(*) as rows, 5 as columns, sha256('doc_id:bigint|text:string|lang:string|source:string|n_chars:bigint') as layout,
  cast(sum(cast('0x' || substr(md5(concat_ws(chr(31), 'v' || doc_id, coalesce('v' || text, 'n'), 'v' || lang, 'v' || source, 'v' || n_chars)), 1, 12) as bigint)) as varchar) as content from documents""")
def fingerprint(spark, sf):
    return E.fingerprint(table(spark, sf, "documents"))


# Retrieval.


@query("select doc_id, cast(o / 1200 as integer) as chunk, trim(substr(text, o + 1, 1200), ' ') as text from (select doc_id, text, unnest(range(0, greatest(length(text), 1), 1200)) as o from documents where text is not null) where length(trim(substr(text, o + 1, 1200), ' ')) >= 1")
def chunk_documents(spark, sf):
    return R.chunks(table(spark, sf, "documents"), "doc_id", "text").withColumn("chunk", F.col("chunk").cast("int"))


INDEX_SQL = "t as (select doc_id, regexp_extract_all(lower(text), '[a-z0-9]+') as t from documents), i as (select doc_id, token, length, count(*) as tf from (select doc_id, len(t) as length, unnest(t) as token from t) group by doc_id, token, length)"


@query("with t as (select regexp_extract_all(lower(text), '[a-z0-9]+') as t from conversations) select token, count(*) as n from (select unnest(t) as token from t) group by token")
def tokens(spark, sf):
    return table(spark, sf, "conversations").select(F.explode(R.tokens(F.col("text"))).alias("token")).groupBy("token").agg(F.count("*").alias("n"))


@query(f"with {INDEX_SQL} select doc_id, token, cast(length as integer) as length, tf from i")
def term_index(spark, sf):
    return R.term_index(table(spark, sf, "documents"), "doc_id", "text")


@query(f"with {INDEX_SQL} select token, count(*) as df from i group by token")
def document_frequency(spark, sf):
    return R.document_frequency(R.term_index(table(spark, sf, "documents"), "doc_id", "text"))


@query(f"""with {INDEX_SQL}, q as (select item_id, token, count(*) as times from (select item_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) as token from benchmark) group by all),
f as (select token, count(*) as df from i group by token), n as (select count(*) as n from documents),
s as (select item_id, doc_id, round(sum(tf / length * times * ln(1 + n / (1 + df))), 4) as score from q join i using (token) join f using (token), n group by all)
select item_id as query, cast(rank as integer) as rank, doc_id as key, score from (select *, row_number() over (partition by item_id order by score desc, doc_id) as rank from s where score > 0) where rank <= 5""")
def keyword_topk(spark, sf):
    return R.keyword_topk(table(spark, sf, "documents"), table(spark, sf, "benchmark"), "doc_id", "text", "item_id", "text", k=5)


def kept_index(spark, sf):
    """An index that came about in steps: documents with a toxicity label under wrong texts, then all others, then the real texts in their place, source by source."""
    docs = table(spark, sf, "documents").select("doc_id", "text", "source")
    marked = docs.join(table(spark, sf, "labels").select("doc_id").distinct(), "doc_id", "left_semi")
    index = TextIndex(spark, new_folder(spark, "index"), key="doc_id")
    index.add(marked.withColumn("text", F.concat(F.lit("wrong "), F.substring("text", 1, 200))), "text", label="source")
    index.add(docs, "text", label="source")  # those that are there stay as they are
    index.replace(docs.join(marked.select("source").distinct(), "source", "left_semi"), "text", label="source", by_label=True)
    return index


@query(f"with {INDEX_SQL} select doc_id, token, cast(length as bigint) as length, tf from i")
def kept_index_postings(spark, sf):
    return kept_index(spark, sf).postings().withColumnRenamed("key", "doc_id")


@query(f"with {INDEX_SQL} select token, count(*) as df, n.documents, n.tokens from i, (select count(*) as documents, cast(sum(len(t)) as bigint) as tokens from t) n group by all")
def kept_index_sizes(spark, sf):
    index = kept_index(spark, sf)
    size = index.size().first()
    return index.frequencies().select("token", "df", F.lit(size["documents"]).alias("documents"), F.lit(size["tokens"]).alias("tokens"))


register("kept_index_topk", ORACLES["keyword_topk"], lambda spark, sf: kept_index(spark, sf).search(table(spark, sf, "benchmark"), "item_id", "text", k=5)[0])


@query("""with u as (select vec_id, list_transform(embedding, lambda x: cast(x as double)) as e from embeddings), n as (select vec_id, e, sqrt(list_dot_product(e, e)) as size from u),
s as (select q.vec_id as query, v.vec_id as key, round(greatest(0.0, list_dot_product(list_transform(v.e, lambda x: x / v.size), list_transform(q.e, lambda x: x / q.size))), 4) as score from n v, n q where q.vec_id % 100 = 0)
select query, cast(rank as integer) as rank, key, score from (select *, row_number() over (partition by query order by score desc, key) as rank from s) where rank <= 5""")
def vector_topk(spark, sf):
    vectors = table(spark, sf, "embeddings")
    return R.vector_topk(vectors, vectors.where("vec_id % 100 = 0"), "vec_id", "embedding", "vec_id")


@query("select doc_id, lang, case when doc_id in (select doc_id from labels) then -1 else n_chars end as n_chars from documents")
def index_upsert(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "lang", "n_chars")
    old = docs.join(table(spark, sf, "labels"), "doc_id", "left_semi").withColumn("n_chars", F.lit(-1).cast("long"))
    return R.upsert(old, docs, "doc_id")


@query("select doc_id, lang, case when lang in (select lang from documents group by lang order by count(*) desc, lang limit 2) then n_chars else 0 end as n_chars from documents")
def index_replace(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "lang", "n_chars")
    most = docs.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(2)
    return R.upsert(docs.withColumn("n_chars", F.lit(0).cast("long")), docs.join(most, "lang", "left_semi"), "doc_id", replace=["lang"])


CATALOGUE = ("orders", "lineitem", "events", "documents")


def catalogue(spark, sf):
    return reduce(DataFrame.unionByName, (P.roles(source(spark, sf, t)).withColumn("dataset", F.lit(t)) for t in CATALOGUE))


_profile = " union all ".join(f"select '{t}' as dataset, {k} as position, '{c}' as column, '{role}' as role, '{kind}' as kind, count(distinct {c}) as n from {t}" for t in CATALOGUE for k, (c, kind, role, _) in enumerate(ROLES[t]))
_terms = ", ".join(f"({k}, '{t}', '{d}')" for k, (t, d) in enumerate(R.GLOSSARY))
_role = lambda r: f"coalesce(string_agg(\"column\", ', ' order by position) filter (where role = '{r}'), '')"
METADATA_SQL = f"""with p as ({_profile}), g(k, term, definition) as (values {_terms}),
d as (select dataset, "column", first(definition order by k) as definition from p join g on contains(lower("column"), term) group by all),
docs as (select dataset, 'overview' as kind, '' as column, 'Table ' || dataset || ': ' || count(*) || ' columns. Metrics: ' || {_role('metric')} || '. Dimensions: ' || {_role('dimension')} || '. Dates: ' || {_role('date')} || '. Identifiers: ' || {_role('identifier')} || '. Texts: ' || {_role('text')} || '.' as text from p group by dataset
  union all select dataset, 'dictionary', '', string_agg("column" || ' / ' || role || ' / ' || kind || ' / ' || n, chr(10) order by position) from p group by dataset
  union all select dataset, 'column', "column", 'Column ' || "column" || ' of ' || dataset || ': ' || role || ', ' || kind || ', ' || n || ' distinct values.' || coalesce(' ' || definition, '') from p left join d using (dataset, "column"))
"""
register("metadata_documents", METADATA_SQL + 'select dataset || \'::\' || kind || case when "column" = \'\' then \'\' else \'::\' || "column" end as id, dataset, kind, "column", text from docs', lambda spark, sf: R.metadata_documents(catalogue(spark, sf)))
register("corpus_counts", METADATA_SQL + "select kind, count(*) as n from docs group by kind", lambda spark, sf: R.metadata_documents(catalogue(spark, sf)).groupBy("kind").agg(F.count("*").alias("n")))
register("glossary_attach", METADATA_SQL + 'select dataset, "column", definition from p left join d using (dataset, "column")', lambda spark, sf: R.glossary(catalogue(spark, sf)).select("dataset", "column", "definition"))


_two = lambda x: f"cast(cast(round({x}, 2) as decimal(38,2)) as varchar)"
_metrics = [(t, k, c) for t in CATALOGUE for k, (c, _, role, _) in enumerate(ROLES[t]) if role == "metric"]
_lines = " union all ".join(f"select '{t}' as dataset, {k} as position, '- {c}: ' || {_two(f'min({c})')} || ' to ' || {_two(f'max({c})')} || ', mean ' || {_two(f'avg({c})')} || ', median ' || {_two(f'quantile_cont(cast({c} as double), 0.5)')} || ', std ' || {_two(f'stddev_samp({c})')} || '.' as line from {t}" for t, k, c in _metrics)
_cleaned = "Order Key to Order Key, status to status (1), a blank name to unnamed. Dropped: unnamed. Read as numbers: Order Key, Price. Read as dates: order date."


@query(f"""with l as ({_lines}) select dataset || '::statistics' as id, dataset, 'statistics' as kind, '' as column, 'Numbers of ' || dataset || ':' || chr(10) || string_agg(line, chr(10) order by position) as text from l group by dataset
union all select 'flat::business_rules', 'flat', 'business_rules', '', 'Measures of flat:' || chr(10) || '- Profit Margin %: sum of profit over sum of sales, times 100.' || chr(10) || '- Average Selling Price: sum of sales over sum of quantity.' || chr(10) || '- Return on Cost %: sum of profit over sum of cost, times 100.'
union all select 'orders::cleaning', 'orders', 'cleaning', '', 'Cleaning of orders: ' || count(*) || ' rows of 7 columns were read, ' || count(*) || ' rows of 6 columns are left. Renamed: {_cleaned}' from orders""")
def metadata_facts(spark, sf):
    found = [(t, P.metric_stats(source(spark, sf, t))) for t in CATALOGUE]
    metrics = [stats.withColumn("dataset", F.lit(t)) for t, stats in found if stats is not None]
    rules = P.derived_metrics(flat(spark, sf)).withColumn("dataset", F.lit("flat"))
    rules = rules.withColumn("position", F.array_position(F.array(*(F.lit(n) for n, *_ in P.DERIVED)), F.col("name")))
    _, report = C.clean(messy(spark, sf))
    parts = [R.statistics_documents(reduce(DataFrame.unionByName, metrics))] if metrics else []
    parts += [R.rules_documents(rules), R.cleaning_document(spark, "orders", report)]
    return reduce(DataFrame.unionByName, parts)


# Text tables.


@query("""select conv_id, turn, case role when 'user' then '' when 'assistant' then trim(text, ' ') else trim(text, ' ') end as answer from conversations""")
def strip_reasoning_blocks(spark, sf):
    rows = table(spark, sf, "conversations")
    before = F.coalesce(F.lag("text").over(Window.partitionBy("conv_id").orderBy("turn")), F.lit("none"))
    wrapped = F.when(F.col("role") == "user", F.concat(F.lit("<think>"), before, F.col("text"))).when(F.col("role") == "assistant", F.concat(F.lit("<THINK>"), before, F.lit("</think>"), F.col("text"), F.lit("<reasoning>"), before, F.lit("</reasoning>"))).otherwise(F.concat(before, F.lit("</thinking>"), F.col("text")))
    return rows.withColumn("wrapped", wrapped).select("conv_id", "turn", strip_reasoning(F.col("wrapped")).alias("answer"))


@query("select event_id, cast(json_extract(props, '$.k') as bigint) as k from events")
def extract_json_plan(spark, sf):
    fenced = F.concat(F.lit("Here is the plan:\n```json\n"), "props", F.lit("\n```\nDone."))
    return table(spark, sf, "events").select("event_id", extract_json(fenced, "k long")["k"].alias("k"))
