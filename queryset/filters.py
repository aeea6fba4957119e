from __future__ import annotations

from pyspark.sql import functions as F

from queryset.fixtures import duck, fixture, layer, table
from queryset.registry import query
from tilewright.functions.text import split_list
from tilewright.operators.filters import audit_filters, filter_layer
from tilewright.plans.tiles import property_names


def _where(name: str, source: str, predicate, condition: str):
    @query(name, f"{duck(source)} select id from {source} where {condition}")
    def run(spark, sf):
        return filter_layer(layer(spark, sf, source), predicate).frame.select("id")


_where("where_compare", "customer_pt",
       ["and", [">", "balance", 100], ["<=", "balance", "7500.5"], ["!=", "segment", "MACHINERY"], [">=", "id", 10],
        ["<", "id", 1400]],
       "balance > 100 and balance <= 7500.5 and segment <> 'MACHINERY' and id >= 10 and id < 1400")
_where("where_in", "customer_pt", ["in", "segment", ["MACHINERY", "HOUSEHOLD"]], "segment in ('MACHINERY','HOUSEHOLD')")
_where("where_between", "customer_pt", ["between", "balance", 0, 5000], "balance between 0 and 5000")
_where("where_like", "customer_pt", ["like", "name", "Customer#0000000_7%"], "name like 'Customer#0000000_7%'")
_where("where_ilike", "customer_pt", ["ilike", "segment", "%hold"], "segment ilike '%hold'")
_where("where_like_escape", "customer_pt", ["or", ["like", "name", "Customer!%%", "!"], ["like", "name", "%#0000001!_%", "!"],
                                            ["ilike", "segment", "auto!__%", "!"], ["like", "segment", "AUTO%", "!"]],
       "name like 'Customer!%%' escape '!' or name like '%#0000001!_%' escape '!' "
       "or segment ilike 'auto!__%' escape '!' or segment like 'AUTO%' escape '!'")
_where("where_null", "customer_pt", ["or", ["is null", "segment"], ["is null", "geom"]], "segment is null or lon is null")
_where("where_not_null", "customer_pt", ["and", ["is not null", "SEGMENT"], ["is not null", "geom"]],
       "segment is not null and lon is not null")
_where("where_bool_tree", "customer_pt",
       ["or", ["and", ["=", "segment", "MACHINERY"], ["not", ["<", "balance", 0]]],
        ["and", ["=", "segment", "FURNITURE"], ["or", ["in", "id", [1, 2, 3, 5, 8]], [">", "balance", 9000]]],
        ["not", ["is not null", "segment"]]],
       "(segment = 'MACHINERY' and not (balance < 0)) or (segment = 'FURNITURE' and (id in (1,2,3,5,8) or balance > 9000))"
       " or not (segment is not null)")
_where("where_coerce_string", "customer_pt", ["in", "code", [7, 12, "3"]], "code in ('7','12','3')")
_where("where_coerce_numeric", "customer_pt", ["or", ["=", "id", "12"], [">", "balance", "9000.5"], ["<", "balance", "-900.25"]],
       "id = 12 or balance > 9000.5 or balance < -900.25")
_where("where_coerce_boolean", "customer_pt", ["and", ["=", "active", "TRUE"], ["!=", "active", 0]],
       "active = true and active <> false")
_where("where_datetime", "order_line", ["between", "placed", "1996-01-01", "1997-06-30 12:00:00"],
       "placed between timestamp '1996-01-01' and timestamp '1997-06-30 12:00:00'")

# a filter text per event: harmless ones and ones that carry statements, comments or casts
FILTER_TEXTS = """
select event_id as filter_id, concat('status = ''', event_type, '''', case event_id % 9
  when 0 then '; drop table t' when 1 then ' -- x' when 2 then ' OR id IN (select 1)' when 3 then ' AND score::int > 1'
  when 4 then ' AND note = $$a$$' when 5 then ' AND dropped = 1' when 6 then ' /* c */' when 7 then ' and with_tax > 2'
  else ' AND score > 10' end) as filter
from [events]"""
WORDS = "SELECT|UPDATE|DELETE|INSERT|MERGE|ALTER|DROP|CREATE|GRANT|REVOKE|CALL|EXECUTE|WITH"
PATTERN = rf"(;|--|/\*|\*/|\$\$|::|\b({WORDS})\b)"


@query("filter_audit", f"""select filter_id, filter, regexp_matches(filter, '{PATTERN}', 'i') as forbidden
from ({FILTER_TEXTS.replace('[events]', 'events')}) t""")
def filter_audit(spark, sf):
    texts = spark.sql(FILTER_TEXTS.replace("[events]", "{events}"), events=table(spark, sf, "events"))
    return audit_filters(texts)


@query("filter_audit_texts", f"select doc_id, regexp_matches(text, '{PATTERN}', 'i') as forbidden from documents")
def filter_audit_texts(spark, sf):
    return audit_filters(table(spark, sf, "documents"), "text").select("doc_id", "forbidden")


@query("project_properties", f"{duck('customer_pt')} select id, segment, balance from customer_pt")
def project_properties(spark, sf):
    made = layer(spark, sf, "customer_pt")
    names = property_names(made, ("id", "nonsense", "segment", "balance", "id"))
    return made.frame.select(*names)


@query("split_properties", r"""
select event_id, list_filter(list_transform(string_split(concat(' ', event_type, ' ,, user', chr(9), ',', props), ','),
  lambda s: regexp_replace(s, '^\s+|\s+$', '', 'g')), lambda s: s <> '') as names from events""")
def split_properties(spark, sf):
    text = F.concat(F.lit(" "), "event_type", F.lit(" ,, user\t,"), "props")
    return table(spark, sf, "events").select("event_id", split_list(text).alias("names"))


@query("where_count_by_status", f"""{duck('order_line')}
select status, count(*) as n from order_line where price > 150000 and status in ('F','O') group by status""")
def where_count(spark, sf):
    kept = filter_layer(layer(spark, sf, "order_line"), ["and", [">", "price", 150000], ["in", "status", ["F", "O"]]])
    return kept.frame.groupBy("status").agg(F.count(F.lit(1)).alias("n"))


@query("client_address", """
select event_id, coalesce(nullif(regexp_replace(string_split(forwarded, ',')[1], '^\\s+|\\s+$', '', 'g'), ''),
  nullif(regexp_replace(real_ip, '^\\s+|\\s+$', '', 'g'), ''), '127.0.0.1') as client
from (select event_id, case event_id % 4 when 0 then concat(' 10.0.0.', cast(user_id % 256 as varchar), ' , 1.1.1.1')
    when 1 then ' ' else null end as forwarded,
  case when event_id % 3 = 0 then concat('10.1.0.', cast(user_id % 256 as varchar)) when event_id % 3 = 1 then '' end as real_ip
 from events) q""")
def client_address_query(spark, sf):
    from tilewright.functions.text import client_address
    i = F.col("event_id")
    last = (F.col("user_id") % 256).cast("string")
    forwarded = F.when(i % 4 == 0, F.concat(F.lit(" 10.0.0."), last, F.lit(" , 1.1.1.1"))).when(i % 4 == 1, " ")
    real = F.when(i % 3 == 0, F.concat(F.lit("10.1.0."), last)).when(i % 3 == 1, "")
    return table(spark, sf, "events").select("event_id", client_address(forwarded, real).alias("client"))
