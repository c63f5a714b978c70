"""Queries of whole stages, summaries, freshness and lookups over the venue tables, with SQL of the same meaning."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lokalis.functions import classify, geo, text
from lokalis.operators import freshness, matching, sequences, sets, summaries
from lokalis.plans import pipelines
from lokalis.plans.venue_queries import DISTANCE, FIELDS, PINS, PLACED, _kind_sql, _resolved_pins, seconds
from lokalis.runtime import table
from lokalis.sinks import maps

c = F.col
QUERIES, SQL = {}, {}
NOW = 1_788_220_800
ODD, EVEN = "month(fetched_at) % 2 = 1", "month(fetched_at) % 2 = 0"  # two runs


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


WANTED = ["brewery", "bottle_shop", "craft_beer_bar", "unsettled"]
DECIDED = f"""d as (select *, kind in ({', '.join(f"'{w}'" for w in WANTED)}) as keep, kind as reason from (select *, {_kind_sql()} as kind, case when coalesce(monthly <= 0 and total >= 50, false) then 'possibly_closed' else '' end as flag from venues))"""


def _filtered(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    flag = F.when(classify.possibly_gone(c("monthly"), c("total")), "possibly_closed").otherwise("")
    return pipelines.filter_stage(table(spark, d, "venues"), classify.phrase_kind(c("category")), WANTED, flag)


@query(f"with {DECIDED} select venue_key, keep, reason, flag from d")
def x_filter(spark: SparkSession, d: str) -> DataFrame:
    return _filtered(spark, d)[0].select("venue_key", "keep", "reason", "flag")


@query(f"""with {DECIDED} select case when grouping(reason) = 1 and grouping(flag) = 1 then 'all' when grouping(flag) = 1 then 'reason' else 'flag' end as level, keep, reason, flag, count(*) as n
    from d group by grouping sets ((keep), (keep, reason), (keep, flag))""")
def a_filter_summary(spark: SparkSession, d: str) -> DataFrame:
    return _filtered(spark, d)[1]


@query(f"select count_if(lat is not null and lng is not null) as placemarks, count_if(lat is null or lng is null) as unplaced, bool_or(coalesce(lat is not null and lng is not null and geo_source in ({', '.join(f"'{s}'" for s in maps.DERIVED)}), false)) as credit from venues")
def a_export_summary(spark: SparkSession, d: str) -> DataFrame:
    return summaries.export_summary(table(spark, d, "venues"), maps.DERIVED)


@query("select case when coalesce(business_status, '') = '' then 'unchecked' else business_status end as business_status, count(*) as n from venues group by 1")
def a_status_tally(spark: SparkSession, d: str) -> DataFrame:
    return summaries.tally(table(spark, d, "venues"), "business_status")


QUERY_TEXT = "concat_ws(', ', nullif(trim(name), ''), nullif(trim(address), ''), nullif(trim(city), ''))"


@query(f"""with a as (select {QUERY_TEXT} as q, min(coalesce(venue_id, '')) as place, arg_min(coalesce(business_status, ''), struct_pack(p := coalesce(venue_id, ''), k := venue_key)) as s from venues where month(fetched_at) % 2 = 0 group by 1)
    select venue_key, case when a.q is null then business_status when place = '' then 'unmatched' else coalesce(nullif(a.s, ''), 'unmatched') end as business_status
    from (select *, {QUERY_TEXT} as q from venues where month(fetched_at) % 2 = 1) v left join a on v.q = a.q""")
def x_closures(spark: SparkSession, d: str) -> DataFrame:
    """The pages of one run take the status that those of the other have under the same query text."""
    v = table(spark, d, "venues").withColumn("q", text.query_text(c("name"), c("address"), c("city")))
    said = v.where(EVEN).groupBy("q").agg(F.min_by(F.struct("venue_id", "business_status"), F.struct(F.coalesce("venue_id", F.lit("")), "venue_key")).alias("r"))
    answers = said.select("q", c("r.venue_id").alias("place_id"), "r.business_status", F.lit(None).cast("string").alias("error"))
    return pipelines.closures_stage(v.where(ODD), answers, "q")[0].select("venue_key", "business_status")


@query(f"""with {PINS}, p as (select sweep_no, (cell * 37) % 900 as x, (cell * 53) % 1500 as y, page_lat, page_lng from pins where cell is not null), a as (select sweep_no, avg(page_lat + (y - 750) * 10.2 / 110540.0) as la from p group by 1)
    select sweep_no, round(any_value(la), 5) as centre_lat, round(avg(page_lng - (x - 450) * 10.2 / (111320 * cos(radians(la)))), 5) as centre_lng from p join a using (sweep_no) group by 1""")
def a_known_centre(spark: SparkSession, d: str) -> DataFrame:
    p = _resolved_pins(spark, d).where("cell is not null").select("sweep_no", (c("cell") * 37 % 900).alias("x"), (c("cell") * 53 % 1500).alias("y"), c("page_lat").alias("lat"), c("page_lng").alias("lng"))
    return summaries.known_centre(p, ["sweep_no"], F.lit(10.2)).select("sweep_no", F.round("centre_lat", 5).alias("centre_lat"), F.round("centre_lng", 5).alias("centre_lng"))


@query(f"with o as (select 46.6 as lat, -1.0 as lng), k as (select venue_key, {DISTANCE.format(r=6371.0088, a='o', b='v')} as km from venues v, o) select venue_key, round(km, 0) as km from k where km is not null order by k.km desc, venue_key limit 5")
def a_worst_offenders(spark: SparkSession, d: str) -> DataFrame:
    return summaries.worst_offenders(table(spark, d, "venues"), geo.haversine_km(F.lit(46.6), F.lit(-1.0), c("lat"), c("lng")), "venue_key")


@query("""select sweep_no, coalesce(nullif(status, ''), 'unchecked') as status, count(*) as n from resolutions group by 1, 2""")
def a_journal_tally(spark: SparkSession, d: str) -> DataFrame:
    return summaries.tally(table(spark, d, "resolutions"), "status", by=["sweep_no"])


@query("""with t as (select sweep_no, count(distinct name) as total from resolutions where name <> '' group by 1), j as (select sweep_no, count_if(status = 'resolved') as ok, count_if(not coalesce(status = 'resolved', false)) as failed from resolutions group by 1)
    select sweep_no, total, coalesce(ok, 0) as ok, coalesce(failed, 0) as failed, total > 0 and coalesce(ok, 0) >= total as done from t left join j using (sweep_no)""")
def a_progress(spark: SparkSession, d: str) -> DataFrame:
    r = table(spark, d, "resolutions")
    return summaries.progress(r, r.where("name <> ''").groupBy("sweep_no").agg(F.count_distinct("name").alias("total")), "sweep_no", ok="resolved")


@query("""with s as (select sweep_no, cell as pos, 'cell ' || cell as stage, min(case when status = 'resolved' then 1 else 0 end) = 1 as done from resolutions where cell is not null group by 1, 2)
    select sweep_no, arg_min(stage, pos) as stage from s where not done group by 1""")
def a_next_stage(spark: SparkSession, d: str) -> DataFrame:
    """The first cell of each sweep that is not wholly resolved."""
    s = table(spark, d, "resolutions").where("cell is not null").groupBy("sweep_no", c("cell").alias("pos")).agg(F.bool_and(F.coalesce(c("status") == "resolved", F.lit(False))).alias("done"))
    return summaries.next_stage(s.withColumn("stage", F.concat(F.lit("cell "), "pos")), ["sweep_no"])


@query(f"""with pg as (select venue_id, arg_min(lat, venue_key) as lat, arg_min(lng, venue_key) as lng from venues where venue_id is not null and {PLACED} group by 1)
    select res_id, case when pg.venue_id is null then 'fetch_failed' when pg.lat between 46.0 and 47.0 and pg.lng between -2.0 and 0.0 then 'resolved' else 'outside' end as status from (select * from resolutions where coalesce(venue_id, '') <> '') r left join pg on r.venue_id = pg.venue_id""")
def j_by_known_id(spark: SparkSession, d: str) -> DataFrame:
    pages = sets.first_by(table(spark, d, "venues").where(PLACED).where("venue_id is not null").select("venue_id", "venue_key", "lat", "lng"), ["venue_id"], ["venue_key"])
    rows = table(spark, d, "resolutions").where(F.coalesce("venue_id", F.lit("")) != "").select("res_id", "venue_id")
    return matching.by_known_id(rows, pages, "res_id", "venue_id", 46.0, 47.0, -2.0, 0.0)


@query("""with n as (select concat_ws(' | ', name, nullif(trim(address), '')) as k, min(geo_source) as s from venues where month(fetched_at) % 2 = 0 group by 1), o as (select name as k, min(geo_source) as s from venues where month(fetched_at) % 2 = 1 group by 1)
    select venue_key, coalesce(n.s, o.s) as status from venues v left join n on concat_ws(' | ', v.name, nullif(trim(v.address), '')) = n.k left join o on v.name = o.k""")
def j_legacy_lookup(spark: SparkSession, d: str) -> DataFrame:
    v = table(spark, d, "venues").withColumn("row", text.row_key(c("name"), c("address"))).withColumn("old", F.concat(F.lit("old "), "name"))
    older = v.where(ODD).where("name is not null").select(c("old").alias("key"), c("geo_source").alias("status"))
    journal = v.where(EVEN).select(c("row").alias("key"), c("geo_source").alias("status")).unionByName(older)
    return matching.legacy_lookup(v.select("venue_key", "row", "old"), journal, "row", "old").select("venue_key", "status")


def _texts(month: int) -> str:
    return f"select venue_id, max(row({', '.join(f"coalesce(cast({f} as varchar), '')" for f in FIELDS)})) as r from venues where month(fetched_at) % 2 = {month} group by 1"


@query(f"""with o as ({_texts(0)}), n as ({_texts(1)}), e as (select venue_id, u.field, u.before, u.after from o join n using (venue_id), unnest([{', '.join(f"struct_pack(field := '{f}', before := o.r[{i}], after := n.r[{i}])" for i, f in enumerate(FIELDS, 1))}]) t(u))
    select venue_id, field, before, after from e where before <> after""")
def s_run_deltas(spark: SparkSession, d: str) -> DataFrame:
    v = table(spark, d, "venues")
    diff = sets.run_diff(v.where(EVEN), v.where(ODD), "venue_id", FIELDS).where("deltas is not null")
    return diff.select("venue_id", F.explode("deltas").alias("field", "e")).select("venue_id", "field", "e.before", "e.after")


@query("""with e as (select event_id, user_id, value as asked, case when event_type in ('click', 'view') then round(value * 1.1, 6) end as measured from events), m as (select *, case when measured is not null and abs(asked) >= 20 then abs(measured) else 0.0 end as dm, case when measured is not null and abs(asked) >= 20 then abs(asked) else 0.0 end as da from e),
    s as (select *, sum(dm) over w - dm as sm, sum(da) over w - da as sa from m window w as (partition by user_id order by event_id))
    select event_id, round(coalesce(measured, asked * coalesce(case when sa <> 0 then greatest(0.8, least(1.4, sm / sa)) end, 1.0)), 4) as used from s""")
def w_pan_account(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select("event_id", "user_id", c("value").alias("asked"), F.when(c("event_type").isin("click", "view"), F.round(c("value") * 1.1, 6)).alias("measured"))
    run = sequences.running_ratio(e, "measured", "asked", "event_id", ["user_id"], least=20)
    return run.select("event_id", F.round(summaries.accounted(run, "measured", "asked"), 4).alias("used"))


@query("""with b as (select sweep_no, name, min(page_no) as x, min(length(name)) as y from venue_refs where page_no <= 20 and name is not null group by 1, 2 having count(*) = 1),
    a as (select sweep_no, name, min(page_no) as x, min(length(name)) as y from venue_refs where page_no > 20 and name is not null group by 1, 2 having count(*) = 1)
    select sweep_no, case when count(*) >= 6 then quantile_cont(a.x - b.x, 0.5) end as dx, case when count(*) >= 6 then quantile_cont(a.y - b.y, 0.5) end as dy, count(*) as shared from a join b using (sweep_no, name) group by 1""")
def w_measured_gate(spark: SparkSession, d: str) -> DataFrame:
    r = table(spark, d, "venue_refs").where("name is not null").select("sweep_no", "name", "page_no", c("page_no").alias("x"), F.length("name").alias("y"))
    return summaries.gated(matching.surviving_displacement(r.where("page_no <= 20").drop("page_no"), r.where("page_no > 20").drop("page_no"), ["sweep_no"]))


@query("""with p as (select sweep_no, (res_id * 37) % 900 as x, (res_id * 53) % 1500 as y from resolutions), g as (select row_number() over (order by gy, gx) as n, gx, gy from (select unnest(range(50, 851, 100)) as gx), (select unnest(range(150, 1351, 100)) as gy) where gx + 200 between 50 and 850 and gy - 300 between 150 and 1350),
    m as (select sweep_no, n, any_value(gx) as gx, any_value(gy) as gy, min(pow(x - gx, 2) + pow(y - gy, 2)) as d2 from p, g group by 1, 2)
    select sweep_no, gx as x, gy as y from m qualify row_number() over (partition by sweep_no order by d2 desc, n) = 1""")
def g_clear_origin(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "resolutions").select("sweep_no", (c("res_id") * 37 % 900).alias("x"), (c("res_id") * 53 % 1500).alias("y"))
    o = summaries.clear_origin(p, ["sweep_no"], 200, -300, (50, 150, 850, 1350), 100)
    return o.select("sweep_no", c("x").cast("bigint").alias("x"), c("y").cast("bigint").alias("y"))


@query("""select venue_key, case when coalesce(total, uniques, monthly) is null then '' else concat_ws(' | ', format('{:,}', total) || ' check-ins', format('{:,}', uniques) || ' unique', format('{:,}', monthly) || '/month', 'as of ' || cast(cast(fetched_at as date) as varchar)) end as note from venues""")
def t_notes(spark: SparkSession, d: str) -> DataFrame:
    v = table(spark, d, "venues")
    return v.select("venue_key", summaries.note_line(c("total"), c("uniques"), c("monthly"), as_of=F.to_date("fetched_at")).alias("note"))


@query(f"""with a as (select venue_key, ({NOW} - epoch_us(fetched_at) // 1000000) / 3600.0 as h from venues) select venue_key, round(h, 1) as age_h, coalesce(h <= 12, false) as half_day, coalesce(h <= 2160, false) as quarter from a""")
def d_fresh(spark: SparkSession, d: str) -> DataFrame:
    at, now = seconds("fetched_at"), F.lit(NOW)
    return table(spark, d, "venues").select("venue_key", F.round(freshness.age_hours(at, now), 1).alias("age_h"), freshness.fresh_within(at, now, 12 * 3600).alias("half_day"), freshness.fresh_within(at, now, 90 * 86_400).alias("quarter"))


@query(f"""select venue_key, venue_id, case when fresh then name end as name, case when fresh then business_status end as business_status from (select *, coalesce({NOW} - epoch_us(fetched_at) // 1000000 < 2592000, false) as fresh from venues) where coalesce(venue_id, '') <> ''""")
def d_content_expiry(spark: SparkSession, d: str) -> DataFrame:
    v = table(spark, d, "venues").select("venue_key", "venue_id", "name", "business_status", seconds("fetched_at").alias("at"))
    return freshness.expired_content(v, "venue_id", ["name", "business_status"], "at", F.lit(NOW), 30 * 86_400).drop("at")


@query("""with n as (select epoch_us(timestamp '2024-01-30 00:00:00') // 1000000 as now), u as (select user_id, count_if(epoch_us(ts) // 1000000 >= now - 86400) as used, max(case when event_type = 'error' then epoch_us(ts) // 1000000 + 21600 end) as until, any_value(now) as now from events, n group by 1)
    select user_id, used, greatest(0, 5 - used) as remaining, cast(greatest(0, coalesce(until - now, 0)) as double) as wait_s, greatest(0, coalesce(until - now, 0)) <= 0 and used < 5 as may_start from u""")
def d_allowance(spark: SparkSession, d: str) -> DataFrame:
    """Use of the last day before a moment, and what a pause of six hours after an error still lasts."""
    e = table(spark, d, "events").withColumn("s", seconds("ts"))
    blocked = e.where("event_type = 'error'").select("user_id", (c("s") + 21_600).alias("until"))
    return freshness.allowance(e, ["user_id"], "s", F.lit(1_706_572_800), 5, blocked)


@query("select res_id, name, cast(null as bigint) as total, case when lat is not null and lng is not null then lat end as lat, case when lat is not null and lng is not null then lng end as lng, case when lat is null or lng is null then 'none' else 'app' end as geo_source from resolutions")
def s_swept_venues(spark: SparkSession, d: str) -> DataFrame:
    return summaries.as_venues(table(spark, d, "resolutions").select("res_id", "name", "lat", "lng")).select("res_id", "name", "total", "lat", "lng", "geo_source")


@query("""select venue_key, array_to_string(list_filter(list_distinct_ordered, lambda p: p <> 'Bar' and p <> 'Restaurant'), '|') as added from (select venue_key, list_transform(string_split(coalesce(category, ''), ','), lambda p: trim(p)) as list_distinct_ordered from venues)""")
def s_list_difference(spark: SparkSession, d: str) -> DataFrame:
    """Names in a list that were not there before."""
    names = text.split_names(c("category"))
    return table(spark, d, "venues").select("venue_key", F.array_join(F.array_except(names, F.array(F.lit("Bar"), F.lit("Restaurant"))), "|").alias("added"))


@query("""with o as (select name, osm_id, coalesce(list_position(['brewery', 'pub', 'bar', 'biergarten', 'alcohol'], kind), 9) as p from osm_venues where trim(name) <> ''), f as (select lower(name) as k, arg_min(name, p * 1000000000000 + osm_id) as name, min(p * 1000000000000 + osm_id) as o from o group by 1)
    select name from f order by o, k limit 60""")
def t_prominent(spark: SparkSession, d: str) -> DataFrame:
    at = F.array_position(F.array(*map(F.lit, ("brewery", "pub", "bar", "biergarten", "alcohol"))), F.coalesce("kind", F.lit("")))
    o = table(spark, d, "osm_venues").withColumn("p", F.when(at == 0, 9).otherwise(at))
    return summaries.prominent_names(o, "name", ["p", "osm_id"])


@query("select res_id, substr(sha256('https://map.example/api' || chr(10) || coalesce(name, '')), 1, 32) as key from resolutions")
def t_answer_key(spark: SparkSession, d: str) -> DataFrame:
    from lokalis.sources.answers import answer_key

    return table(spark, d, "resolutions").select("res_id", answer_key(F.lit("https://map.example/api"), F.coalesce("name", F.lit(""))).alias("key"))


@query()
def x_enrich(spark: SparkSession, d: str) -> DataFrame:
    """Every swept name with its outcome: candidates ranked by name, verified by distance, shared shifts accepted, duplicates marked."""
    names = table(spark, d, "resolutions").select(c("res_id").alias("name_id"), "sweep_no", "name", "lat", "lng")
    refs = table(spark, d, "venue_refs").where("name is not null").select("ref_id", "sweep_no", "name", "city", "address", c("venue_id").alias("page_id"))
    pages = sets.first_by(table(spark, d, "venues").where(PLACED).where("venue_id is not null").select(c("venue_id").alias("page_id"), "venue_key", "lat", "lng"), ["page_id"], ["venue_key"])
    return pipelines.enrich_stage(names, refs, pages.select("page_id", "lat", "lng"), ["sweep_no"])[1]


@query("""select venue_key, total is not null and uniques is not null and monthly is not null as counted, coalesce(business_status in ('CLOSED_PERMANENTLY', 'CLOSED_TEMPORARILY'), false) as closed,
    len(list_filter(string_split(coalesce(category, ''), ','), lambda p: lower(trim(p)) in ('pub', 'bar', 'brewery', 'taproom'))) > 0 as drinking, coalesce(total >= 55, false) as many from venues""")
def t_predicates(spark: SparkSession, d: str) -> DataFrame:
    v = table(spark, d, "venues")
    return v.select("venue_key", classify.full_counts(c("total"), c("uniques"), c("monthly")).alias("counted"), classify.said_closed(c("business_status")).alias("closed"), classify.has_part(c("category"), ["pub", "bar", "brewery", "taproom"]).alias("drinking"), classify.cut_off(c("total")).alias("many"))


@query("""select osm_id, 'https://pages.example/search?q=' || replace(url_encode(regexp_replace(coalesce(name, ''), '[^A-Za-z ]', '', 'g')), '%20', '+') as url from osm_venues""")
def t_search_url(spark: SparkSession, d: str) -> DataFrame:
    plain = F.regexp_replace(F.coalesce("name", F.lit("")), "[^A-Za-z ]", "")
    return table(spark, d, "osm_venues").select("osm_id", text.search_url("https://pages.example", plain).alias("url"))
