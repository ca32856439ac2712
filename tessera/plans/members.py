"""Queries over membership, roles, properties and policies. Customers stand for users, nations for groups, orders for
memberships, order priorities and parts for roles."""

from __future__ import annotations

import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import access
from tessera.functions import text as tx
from tessera.operators import filters, paging, relational
from tessera.plans.registry import query
from tessera.session import scan
from tessera.sources import files


@query("SELECT n_nationkey, n_name, n_regionkey FROM nation WHERE n_nationkey = 7")
def point_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(spark, sf_dir, "nation", "n_nationkey", "n_name", "n_regionkey").where("n_nationkey = 7")


@query("""SELECT c_custkey, c_name FROM customer WHERE lower(coalesce(c_name, '')) LIKE '%r#00000_1%' OR lower(coalesce(c_mktsegment, '')) LIKE '%r#00000_1%'""")
def keyword_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    users = scan(spark, sf_dir, "customer", "c_custkey", "c_name", "c_mktsegment")
    return users.where(filters.keyword(" R#00000_1 ", F.col("c_name"), F.col("c_mktsegment"))).select("c_custkey", "c_name")


@query("SELECT c_custkey FROM customer WHERE lower(coalesce(c_mktsegment, '')) LIKE '%build%'")
def keyword_search_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    users = scan(spark, sf_dir, "customer", "c_custkey", "c_name", "c_mktsegment")
    allowed = {"name": F.col("c_name"), "segment": F.col("c_mktsegment")}
    return users.where(filters.keyword("Build", allowed=allowed, chosen=["segment", "secret"])).select("c_custkey")


@query("""SELECT event_id, user_id FROM events WHERE event_type = 'error' AND ts >= TIMESTAMP '2024-01-05 00:00:00' AND ts < TIMESTAMP '2024-01-12 00:00:00' AND lower(props) LIKE '%"k": 6%'""")
def dynamic_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = scan(spark, sf_dir, "events", "event_id", "user_id", "event_type", "ts", "props")
    day = lambda d: datetime.datetime(2024, 1, d)
    found = filters.Conditions().equals(F.col("event_type"), "error").equals(F.col("user_id"), None).like(F.col("props"), '"K": 6').between(F.col("ts").cast("timestamp"), day(5), day(12))
    return rows.where(found.all()).select("event_id", "user_id")


@query("SELECT p_partkey, p_brand FROM part WHERE p_size IN (1, 5, 9)")
def in_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filters.in_list(scan(spark, sf_dir, "part", "p_partkey", "p_brand", "p_size"), "p_size", [1, 5, 9]).drop("p_size")


@query("SELECT doc_id, quality FROM labels WHERE quality IS NOT NULL AND quality >= 1 AND toxic < 1")
def metadata_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = scan(spark, sf_dir, "labels", "doc_id", "quality", "toxic")
    meta = F.create_map(F.lit("quality"), F.col("quality").cast("string"), F.lit("toxic"), F.col("toxic").cast("string"))
    wanted = filters.MetadataFilter(ranges={"quality": filters.Range(low=1), "toxic": filters.Range(high=1, with_high=False)}, use_ranges=True)
    return rows.where(wanted.predicate(meta, F.lit(None).cast("string"), F.lit(None).cast("string"))).select("doc_id", "quality")


@query("SELECT d.doc_id, d.lang, l.quality FROM documents d JOIN labels l USING (doc_id) WHERE l.toxic = 0")
def documents_labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = scan(spark, sf_dir, "labels", "doc_id", "quality", "toxic").where("toxic = 0")
    return scan(spark, sf_dir, "documents", "doc_id", "lang").join(labels, "doc_id").select("doc_id", "lang", "quality")


@query("SELECT c.c_custkey, n.n_name, r.r_name FROM customer c JOIN nation n ON c_nationkey = n_nationkey JOIN region r ON n_regionkey = r_regionkey")
def users_of_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    users = scan(spark, sf_dir, "customer", "c_custkey", F.col("c_nationkey").alias("n_nationkey"))
    nations = scan(spark, sf_dir, "nation", "n_nationkey", "n_name", F.col("n_regionkey").alias("r_regionkey"))
    return relational.through_bridge(users, nations, scan(spark, sf_dir, "region", "r_regionkey", "r_name"), "n_nationkey", "r_regionkey").select("c_custkey", "n_name", "r_name")


@query("""SELECT DISTINCT c.c_custkey, c.c_name FROM customer c JOIN orders o ON c.c_custkey = o.o_custkey
JOIN lineitem l ON o.o_orderkey = l.l_orderkey WHERE l.l_returnflag = 'R' AND l.l_quantity >= 49""")
def users_via_group_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    users = scan(spark, sf_dir, "customer", "c_custkey", "c_name")
    members = scan(spark, sf_dir, "orders", F.col("o_custkey").alias("c_custkey"), "o_orderkey")
    grants = scan(spark, sf_dir, "lineitem", F.col("l_orderkey").alias("o_orderkey"), "l_returnflag", "l_quantity").where("l_returnflag = 'R' AND l_quantity >= 49")
    return relational.holders(users, members, grants, "c_custkey", "o_orderkey")


@query("""SELECT c.c_custkey, count(o.o_orderkey) AS members FROM customer c LEFT JOIN orders o ON c.c_custkey = o.o_custkey GROUP BY c.c_custkey""")
def member_count_left(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = scan(spark, sf_dir, "customer", "c_custkey")
    return relational.member_counts(groups, scan(spark, sf_dir, "orders", F.col("o_custkey").alias("c_custkey"), "o_orderkey"), "c_custkey", "o_orderkey")


@query("""SELECT n.n_nationkey, n.n_name, count(a.c_custkey) AS members FROM nation n
JOIN (SELECT DISTINCT c_nationkey FROM customer WHERE c_mktsegment = 'BUILDING' AND c_acctbal > 9000) m ON n.n_nationkey = m.c_nationkey
LEFT JOIN customer a ON a.c_nationkey = n.n_nationkey GROUP BY n.n_nationkey, n.n_name""")
def member_count_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    members = scan(spark, sf_dir, "customer", F.col("c_nationkey").alias("n_nationkey"), "c_custkey", "c_mktsegment", "c_acctbal")
    return relational.groups_of_member(scan(spark, sf_dir, "nation", "n_nationkey", "n_name"), members, "n_nationkey", "c_custkey", (F.col("c_mktsegment") == "BUILDING") & (F.col("c_acctbal") > 9000))


@query("SELECT s_suppkey, (SELECT count(*) FROM lineitem l WHERE l.l_suppkey = s.s_suppkey AND l.l_returnflag = 'A') AS members FROM supplier s")
def member_count_scalar(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = scan(spark, sf_dir, "lineitem", F.col("l_suppkey").alias("s_suppkey"), "l_returnflag").where("l_returnflag = 'A'").withColumn("one", F.lit(1))
    return relational.member_counts(scan(spark, sf_dir, "supplier", "s_suppkey"), rows, "s_suppkey", "one")


@query("""SELECT c_custkey FROM customer c WHERE EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_orderpriority = '1-URGENT' AND o.o_totalprice > 300000)
OR EXISTS (SELECT 1 FROM nation n JOIN region r ON n.n_regionkey = r.r_regionkey WHERE n.n_nationkey = c.c_nationkey AND r.r_name = 'ASIA')""")
def roles_effective(spark: SparkSession, sf_dir: str) -> DataFrame:
    users = scan(spark, sf_dir, "customer", "c_custkey", "c_nationkey")
    direct = scan(spark, sf_dir, "orders", F.col("o_custkey").alias("c_custkey"), "o_orderpriority", "o_totalprice").where("o_orderpriority = '1-URGENT' AND o_totalprice > 300000")
    groups = scan(spark, sf_dir, "nation", F.col("n_nationkey").alias("c_nationkey"), F.col("n_regionkey").alias("r_regionkey")).join(scan(spark, sf_dir, "region", "r_regionkey", "r_name").where("r_name = 'ASIA'"), "r_regionkey")
    return relational.effective(users, "c_custkey", direct, users.join(groups, "c_nationkey", "left_semi")).select("c_custkey")


@query("SELECT count(*) > 0 AS found FROM lineitem WHERE l_quantity > 49 AND l_returnflag = 'N'")
def exists_flag(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relational.exists(scan(spark, sf_dir, "lineitem", "l_quantity", "l_returnflag"), (F.col("l_quantity") > 49) & (F.col("l_returnflag") == "N"))


@query("SELECT o_orderpriority, count(DISTINCT o_custkey) AS users FROM orders GROUP BY o_orderpriority")
def distinct_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(spark, sf_dir, "orders", "o_orderpriority", "o_custkey").groupBy("o_orderpriority").agg(F.countDistinct("o_custkey").alias("users"))


@query("SELECT o_custkey, count(*) AS n FROM orders WHERE o_custkey IN (1, 2, 4, 5, 7) GROUP BY o_custkey")
def count_by_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filters.in_list(scan(spark, sf_dir, "orders", "o_custkey"), "o_custkey", [1, 2, 4, 5, 7]).groupBy("o_custkey").agg(F.count("*").alias("n"))


@query("SELECT DISTINCT c_mktsegment, c_nationkey FROM customer")
def distinct_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(spark, sf_dir, "customer", "c_mktsegment", "c_nationkey").distinct()


@query("""SELECT c_custkey, coalesce((SELECT string_agg(o_orderpriority || '=' || v, ';' ORDER BY o_orderpriority) FROM (
  SELECT o_custkey, o_orderpriority, min(o_orderstatus) AS v FROM orders GROUP BY o_custkey, o_orderpriority) p WHERE p.o_custkey = c_custkey), '') AS properties FROM customer""")
def eav_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    owners = scan(spark, sf_dir, "customer", "c_custkey")
    props = scan(spark, sf_dir, "orders", F.col("o_custkey").alias("c_custkey"), "o_orderpriority", "o_orderstatus")
    folded = relational.folded_properties(owners, props, "c_custkey", "o_orderpriority", "o_orderstatus")
    return folded.select("c_custkey", F.array_join(F.transform(F.map_entries("properties"), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ";").alias("properties"))


@query("SELECT l_orderkey, max(l_linenumber) + 1 AS next_order FROM lineitem GROUP BY l_orderkey")
def next_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relational.next_order(scan(spark, sf_dir, "lineitem", "l_orderkey", "l_linenumber"), ["l_orderkey"], "l_linenumber")


@query("""SELECT o_orderkey, o_totalprice, (SELECT count(*) FROM orders WHERE o_orderstatus = 'F') AS total FROM orders WHERE o_orderstatus = 'F'
ORDER BY o_totalprice DESC NULLS LAST, o_orderkey LIMIT 20 OFFSET 40""")
def page_with_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = scan(spark, sf_dir, "orders", "o_orderkey", "o_totalprice", "o_orderstatus").where("o_orderstatus = 'F'").drop("o_orderstatus")
    order = paging.ordering({"price": F.col("o_totalprice"), "key": F.col("o_orderkey")}, "key", "Price", True, F.col("o_orderkey"))
    return paging.page_with_total(rows, order, paging.PageRequest(40, 20))


@query("""SELECT o_orderkey, o_totalprice, total FROM (SELECT o_orderkey, o_totalprice, row_number() OVER (ORDER BY o_totalprice DESC NULLS LAST, o_orderkey) AS n, count(*) OVER () AS total FROM orders)
WHERE n > total - total // 3 AND n <= total - total // 3 + 120""")
def deep_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """120 orders from behind two thirds of all, by price."""
    index = paging.PageIndex(scan(spark, sf_dir, "orders", "o_orderkey", "o_totalprice"), [F.col("o_totalprice").desc_nulls_last(), F.asc("o_orderkey")])
    return index.page(paging.PageRequest(index.total - index.total // 3, 120)).withColumn("total", F.lit(index.total).cast("long"))


@query("""WITH t AS (SELECT s_suppkey, s_name, row_number() OVER (ORDER BY s_name, s_suppkey) AS n, count(*) OVER () AS c FROM supplier)
SELECT s_suppkey, s_name, c > 10 AS has_more FROM t WHERE n <= 10""")
def page_with_more(spark: SparkSession, sf_dir: str) -> DataFrame:
    return paging.page_with_more(scan(spark, sf_dir, "supplier", "s_suppkey", "s_name"), [F.asc("s_name"), F.asc("s_suppkey")], paging.PageRequest(0, 10))


@query("SELECT url AS key FROM pages WHERE url > (SELECT min(url) FROM pages WHERE url LIKE 'h%') AND url LIKE 'h%' ORDER BY url LIMIT 15")
def object_list_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = scan(spark, sf_dir, "pages", F.col("url").alias("key"))
    first = keys.where(F.col("key").startswith("h")).agg(F.min("key")).first()[0]
    return paging.after_token(keys, "key", first, 15, prefix="h")


@query("SELECT DISTINCT regexp_extract(url, '^(https?://[^/]+/)', 1) AS key FROM pages WHERE url LIKE 'http%' AND regexp_matches(url, '^https?://[^/]+/')")
def object_prefixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = scan(spark, sf_dir, "pages", "url").where(F.col("url").rlike("^https?://[^/]+/")).select(F.regexp_extract("url", "^https?://(.+)$", 1).alias("key"), F.regexp_extract("url", "^(https?://)", 1).alias("scheme"))
    return files.listing(keys.select("key"), "", "/").where("is_prefix").join(keys.select("scheme", F.concat(F.substring_index("key", "/", 1), F.lit("/")).alias("key")).distinct(), "key").select(F.concat("scheme", "key").alias("key"))


MASK = "(l_linenumber * 7 + l_suppkey) % 128"


@query(f"""WITH m AS (SELECT l_orderkey, l_linenumber, CAST({MASK} AS INTEGER) AS mask FROM lineitem)
SELECT l_orderkey, l_linenumber, mask, array_to_string(list_sort(list_filter([
  CASE WHEN mask & 16 > 0 THEN 'ADMIN' END,
  CASE WHEN mask & 20 > 0 THEN 'CREATE' END,
  CASE WHEN mask & 24 > 0 THEN 'DELETE' END,
  CASE WHEN mask & 48 > 0 THEN 'DOWNLOAD' END,
  CASE WHEN mask & 115 > 0 THEN 'READ' END,
  CASE WHEN mask & 80 > 0 THEN 'UPLOAD' END,
  CASE WHEN mask & 82 > 0 THEN 'WRITE' END], lambda x: x IS NOT NULL)), ',') AS permissions FROM m""")
def acl_mask_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = scan(spark, sf_dir, "lineitem", "l_orderkey", "l_linenumber", "l_suppkey").withColumn("mask", F.expr(MASK).cast("int"))
    return rows.select("l_orderkey", "l_linenumber", "mask", F.array_join(access.permissions(F.col("mask")), ",").alias("permissions"))


@query(f"""WITH e AS (SELECT l_partkey AS object_id, l_suppkey AS sid_id, CAST({MASK} AS INTEGER) AS mask FROM lineitem WHERE l_returnflag = 'R'),
j AS (SELECT p_brand AS domain, p_type AS component, upper(trim('role_' || c.s_nationkey, 'role_')) AS role, mask FROM e JOIN part ON p_partkey = object_id JOIN supplier c ON s_suppkey = sid_id WHERE s_acctbal >= 0),
a AS (SELECT domain, component, role, unnest(['read', 'write', 'admin']) AS action, unnest([mask & 115 > 0, mask & 82 > 0, mask & 16 > 0]) AS yes FROM j)
SELECT domain, component, action, string_agg(DISTINCT role, ',' ORDER BY role) AS roles FROM a WHERE yes GROUP BY domain, component, action""")
def acl_policy(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = scan(spark, sf_dir, "lineitem", "l_partkey", "l_suppkey", "l_linenumber", "l_returnflag")
    entries = lines.select(F.col("l_partkey").alias("object_id"), F.col("l_suppkey").alias("sid_id"), F.expr(MASK).cast("int").alias("mask"), (F.col("l_returnflag") == "R").alias("granting"))
    part = scan(spark, sf_dir, "part", "p_partkey", "p_brand", "p_type")
    identities = part.select(F.col("p_partkey").alias("object_id"), F.col("p_brand").alias("class_id"), F.col("p_type").alias("component"))
    sids = scan(spark, sf_dir, "supplier", F.col("s_suppkey").alias("sid_id"), F.concat(F.lit("ROLE_"), F.col("s_nationkey")).alias("sid"), (F.col("s_acctbal") < 0).alias("principal"))
    classes = part.select(F.col("p_brand").alias("class_id"), F.col("p_brand").alias("domain")).distinct()
    return relational.policy(entries, identities, classes, sids).withColumn("roles", F.array_join("roles", ","))


@query("""SELECT coalesce(b.k, a.k) AS k, coalesce(b.roles, a.roles) AS roles FROM
(SELECT n_regionkey AS k, min(n_name) AS roles FROM nation GROUP BY 1) a FULL JOIN
(SELECT r_regionkey + 2 AS k, CASE WHEN r_regionkey % 2 = 0 THEN r_name END AS roles FROM region) b ON a.k = b.k""")
def policy_overlay(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = scan(spark, sf_dir, "nation", "n_regionkey", "n_name").groupBy(F.col("n_regionkey").alias("k")).agg(F.min("n_name").alias("roles"))
    later = scan(spark, sf_dir, "region", (F.col("r_regionkey") + 2).alias("k"), F.when(F.col("r_regionkey") % 2 == 0, F.col("r_name")).alias("roles"))
    return relational.overlay(base, later, ["k"], ["roles"])


@query("""SELECT p_partkey, CASE WHEN p_size > 40 THEN 'STATUS' WHEN p_retailprice * 1024 > 1 * 1048576 THEN 'SIZE'
  WHEN NOT (p_brand LIKE '%1' OR p_brand LIKE '%3') THEN 'EXTENSION' WHEN p_type NOT LIKE 'PROMO%' AND p_type NOT LIKE 'STANDARD%' THEN 'MIME' END AS violation FROM part""")
def upload_policy(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = scan(spark, sf_dir, "part", "p_partkey", "p_size", "p_retailprice", "p_brand", "p_type")
    status = F.when(F.col("p_size") > 40, "disabled").otherwise("ACTIVE")
    kind = F.concat(F.split_part("p_type", F.lit(" "), F.lit(1)), F.lit("/x"))
    found = filters.upload_violation(F.col("p_retailprice") * 1024, F.substring("p_brand", -1, 1), kind, status, F.lit(1), F.lit("1, 3"), F.lit("promo/*, standard/x"))
    return rows.select("p_partkey", found.alias("violation"))


@query("""SELECT page_id, CASE WHEN page_id % 4 = 0 THEN 'HTML' WHEN page_id % 4 = 1 THEN 'PDF' WHEN page_id % 4 = 2 THEN 'TEXT' ELSE 'UNKNOWN' END AS format,
  CASE WHEN page_id % 4 = 0 THEN 'htm' WHEN page_id % 4 = 1 THEN 'pdf' WHEN page_id % 4 = 2 THEN 'log' END AS extension FROM pages""")
def file_formats(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.element_at(F.array(F.lit("a.b.HTM"), F.lit("c.pdf"), F.lit("d.LOG"), F.lit("e.")), (F.col("page_id") % 4 + 1).cast("int"))
    return scan(spark, sf_dir, "pages", "page_id").select("page_id", files.file_format(F.lit(None).cast("string"), name).alias("format"), tx.file_extension(name).alias("extension"))


@query("""SELECT r_regionkey, lower(r_name) AS domain, CASE WHEN r_regionkey % 2 = 0 THEN 'files' END AS component, upper(r_name) AS role,
  CASE WHEN r_regionkey % 2 = 0 THEN 'read' ELSE 'write' END AS action FROM region""")
def resource_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    even = F.col("r_regionkey") % 2 == 0
    key = F.concat("r_name", F.when(even, ":Files").otherwise(":*"))
    res = access.resource(key)
    return scan(spark, sf_dir, "region", "r_regionkey", "r_name").select("r_regionkey", res["domain"].alias("domain"), res["component"].alias("component"), access.role_name(F.concat(F.lit(" role_"), F.lower("r_name"))).alias("role"), access.action_name(F.when(even, "View").otherwise("manage")).alias("action"))
