"""Queries of the text, place, join, aggregate, sequence and set operators over the venue tables, with SQL of the same meaning."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lokalis.functions import classify, geo, text
from lokalis.operators import aggregates, fit, harvest, matching, sequences, sets
from lokalis.runtime import table
from lokalis.sinks import maps

c = F.col
DISTANCE = "2 * {r} * asin(least(1.0, sqrt(pow(sin(radians({b}.lat - {a}.lat) / 2), 2) + cos(radians({a}.lat)) * cos(radians({b}.lat)) * pow(sin(radians({b}.lng - {a}.lng) / 2), 2))))"
PLACED = "lat is not null and lng is not null and abs(lat) <= 90 and abs(lng) <= 180 and not (lat = 0 and lng = 0)"
QUERIES, SQL = {}, {}


def seconds(name: str):
    """Whole seconds since 1970 of a timestamp without zone, whatever the session's zone."""
    return F.timestamp_diff("SECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), c(name).cast("timestamp_ntz"))


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


# Text


@query("""select venue_key, array_to_string(list_transform(list_filter(string_split(coalesce(category, ''), ','), lambda p: trim(p) <> ''), lambda p: lower(strip_accents(trim(p)))), '|') as parts from venues""")
def t_category_parts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "venues").select("venue_key", F.array_join(text.category_parts(c("category")), "|").alias("parts"))


@query(r"""select res_id, cast(round_even(cast(nullif(rtrim(replace(regexp_extract(detail, '(\d[\d,.]*)', 1), ',', ''), '.'), '') as double)
    * case when regexp_matches(detail, '^[^\d]*\d[\d,.]*\s*[kK]([^A-Za-z]|$)') then 1e3 when regexp_matches(detail, '^[^\d]*\d[\d,.]*\s*[mM]([^A-Za-z]|$)') then 1e6 else 1 end, 0) as bigint) as n from resolutions""")
def t_count(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "resolutions").select("res_id", text.parse_count(c("detail")).alias("n"))


@query("""select ref_id, case when coalesce(slug, '') <> '' and coalesce(venue_id, '') <> '' then 'https://pages.example/v/' || slug || '/' || venue_id else '' end as url,
    case when coalesce(slug, '') <> '' and regexp_full_match(coalesce(venue_id, ''), '[0-9]+') then slug else '' end as slug from venue_refs""")
def t_page_url(spark: SparkSession, d: str) -> DataFrame:
    u = table(spark, d, "venue_refs").select("ref_id", text.page_url("https://pages.example", c("slug"), c("venue_id")).alias("url"))
    return u.select("ref_id", "url", F.when(c("url") != "", text.slug_of_url(c("url"))).otherwise("").alias("slug"))


@query("""select venue_key, concat_ws(', ', nullif(trim(name), ''), nullif(trim(address), ''), nullif(trim(city), '')) as q,
    concat_ws(' | ', name, nullif(trim(address), '')) as k from venues""")
def t_query_text(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "venues").select("venue_key", text.query_text(c("name"), c("address"), c("city")).alias("q"), text.row_key(c("name"), c("address")).alias("k"))


@query("""select venue_key, concat_ws(' | ', case when total is null then 'check-ins n/a' else format('{:,}', total) || ' check-ins' end, format('{:,}', uniques) || ' unique', format('{:,}', monthly) || '/month', nullif(category, '')) as line from venues""")
def t_stats_line(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "venues").select("venue_key", text.stats_line(c("total"), c("uniques"), c("monthly"), c("category")).alias("line"))


@query("""select venue_key, cast(total as bigint) as total, lat, lng from venues""")
def t_typed_rows(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "venues").select("venue_key", F.format_number("total", 0).alias("total"), c("lat").cast("string").alias("lat"), c("lng").cast("string").alias("lng"))
    return rows.select("venue_key", text.strict_count(c("total")).alias("total"), text.number_or_null(c("lat")).alias("lat"), text.number_or_null(c("lng")).alias("lng"))


@query()
def t_join_names(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "venue_refs").select("ref_id", text.join_name(c("name")).alias("joined"), text.base_name(c("name")).alias("base"), text.calibration_keys(c("name")).alias("keys"), text.city_slug(F.coalesce("city", F.lit(""))).alias("slug"))


@query("""select osm_id, coalesce(nullif(tags['amenity'], ''), nullif(tags['craft'], ''), nullif(tags['shop'], ''), 'unknown') as kind,
    coalesce(tags['amenity'], '') in ('bar', 'pub', 'biergarten') or coalesce(tags['craft'], '') in ('brewery', 'distillery') or coalesce(tags['microbrewery'], '') = 'yes' or coalesce(tags['shop'], '') = 'alcohol' as drinking from osm_venues""")
def t_osm_kind(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "osm_venues").select("osm_id", classify.osm_kind(c("tags")).alias("kind"), classify.drinking_element(c("tags")).alias("drinking"))


def _kind_sql() -> str:
    line = "lower(strip_accents(coalesce(category, '')))"
    return "case " + " ".join(f"when {' or '.join(f"contains({line}, '{p}')" for p in ps)} then '{k}'" for k, ps in classify.KIND_PHRASES.items()) + " else 'unsettled' end"


@query(f"""select kind, count(*) as n, count(case when uniques <= 3 and total >= 20 then 1 end) as homes, count(case when monthly <= 0 and total >= 50 then 1 end) as gone
    from (select *, {_kind_sql()} as kind from venues) group by kind""")
def t_kinds(spark: SparkSession, d: str) -> DataFrame:
    v = table(spark, d, "venues").withColumn("kind", classify.phrase_kind(c("category")))
    return v.groupBy("kind").agg(F.count("*").alias("n"), F.count_if(classify.possible_home(c("uniques"), c("total"))).alias("homes"), F.count_if(classify.possibly_gone(c("monthly"), c("total"))).alias("gone"))


# Places


@query(f"""select r.res_id, v.venue_key, round({DISTANCE.format(r=6371000.0, a='r', b='v')}, 3) as m,
    round((v.lng - r.lng) * 111320 * cos(radians(r.lat)), 3) as east, round((v.lat - r.lat) * 111320, 3) as north from resolutions r join venues v on r.venue_id = v.venue_id""")
def g_pin_to_page(spark: SparkSession, d: str) -> DataFrame:
    r, v = table(spark, d, "resolutions").select("res_id", "venue_id", c("lat").alias("rlat"), c("lng").alias("rlng")), table(spark, d, "venues").select("venue_key", "venue_id", "lat", "lng")
    j = r.join(v, "venue_id")
    off = geo.planar_offset(c("rlat"), c("rlng"), c("lat"), c("lng"))
    return j.select("res_id", "venue_key", F.round(geo.haversine_m(c("rlat"), c("rlng"), c("lat"), c("lng")), 3).alias("m"), F.round(off["east"], 3).alias("east"), F.round(off["north"], 3).alias("north"))


@query(f"""with o as (select 46.6 as lat, -1.0 as lng), k as (select {DISTANCE.format(r=6371.0088, a='o', b='v')} as km from venues v, o)
    select case when km is null then 'unplaceable' when km <= 5.0 then 'kept' else 'dropped' end as side, count(*) as n, round(max(case when km <= 5.0 then km end), 3) as furthest from k group by 1""")
def g_radius_split(spark: SparkSession, d: str) -> DataFrame:
    v = table(spark, d, "venues").withColumn("km", geo.haversine_km(F.lit(46.6), F.lit(-1.0), c("lat"), c("lng"))).withColumn("side", geo.radius_side(c("lat"), c("lng"), F.lit(46.6), F.lit(-1.0), 5.0))
    return v.groupBy("side").agg(F.count("*").alias("n"), F.round(F.max(F.when(c("side") == "kept", c("km"))), 3).alias("furthest"))


@query("""with w as (select city_id, metro_lat as y, metro_lng as x, 450 * 10.2 / (111320 * cos(radians(metro_lat))) as dx, 662 * 10.2 / 110540.0 as dy from cities),
    q as (select city_id, i, x + case when i in (0, 2) then -dx else -0.3 * dx end as l, x + case when i in (1, 3) then dx else 0.3 * dx end as r,
          y + case when i in (0, 1) then -dy else -0.3 * dy end as b, y + case when i in (2, 3) then dy else 0.3 * dy end as t from w, (values (0), (1), (2), (3)) n(i))
    select city_id, i as quarter, round(l, 7) as "left", round(r, 7) as "right", round(b, 7) as bottom, round(t, 7) as top from q""")
def g_quarters(spark: SparkSession, d: str) -> DataFrame:
    w = table(spark, d, "cities").select("city_id", geo.viewport_cell(c("metro_lat"), c("metro_lng"), F.lit(10.2)).alias("cell"))
    q = w.select("city_id", F.posexplode(geo.quarters(c("cell"), 0.3)).alias("quarter", "q"))
    return q.select("city_id", "quarter", *(F.round(f"q.{k}", 7).alias(k) for k in ("left", "right", "bottom", "top")))


# Joins


def _resolved_pins(spark: SparkSession, d: str) -> DataFrame:
    """Pins with the point of the page that their resolution names: the first row of each page."""
    pages = sets.first_by(table(spark, d, "venues").where(PLACED).select("venue_id", "venue_key", c("lat").alias("page_lat"), c("lng").alias("page_lng")), ["venue_id"], ["venue_key"])
    r = table(spark, d, "resolutions").where(c("lat").isNotNull() & c("lng").isNotNull())
    return r.select("res_id", "sweep_no", "cell", "status", "venue_id", c("lat").alias("pin_lat"), c("lng").alias("pin_lng")).join(pages.drop("venue_key"), "venue_id")


PINS = f"""pg as (select venue_id, arg_min(lat, venue_key) as page_lat, arg_min(lng, venue_key) as page_lng from venues where {PLACED} and venue_id is not null group by venue_id),
    pins as (select r.res_id, r.sweep_no, r.cell, r.status, r.venue_id, r.lat as pin_lat, r.lng as pin_lng, page_lat, page_lng from resolutions r join pg on r.venue_id = pg.venue_id where r.lat is not null and r.lng is not null)"""


@query("""with b as (select lower(name) as k, min(osm_id) as lo, max(osm_id) as hi from osm_venues where name <> '' group by 1)
    select v.venue_key, b.lo as osm_id from venues v join b on lower(v.name) = b.k and b.lo = b.hi where v.name <> ''""")
def j_unambiguous(spark: SparkSession, d: str) -> DataFrame:
    key = F.array(F.lower("name"))
    v, o = (table(spark, d, t).where(c("name") != "") for t in ("venues", "osm_venues"))
    return matching.unambiguous(v, o, "venue_key", "osm_id", key, key)


@query()
def j_known_keys(spark: SparkSession, d: str) -> DataFrame:
    return matching.match_known(table(spark, d, "venues"), table(spark, d, "osm_venues"), "venue_key", "osm_id")


@query(f"""with pg as (select venue_id as page_id, arg_min(lat, venue_key) as plat, arg_min(lng, venue_key) as plng from venues where venue_id is not null and {PLACED} group by 1),
    cand as (select r.res_id, f.venue_id as page_id, min(f.ref_id) as first_ref from resolutions r join venue_refs f on r.sweep_no = f.sweep_no and r.name = f.name group by 1, 2),
    ranked as (select *, row_number() over (partition by res_id order by first_ref) as rank from cand),
    tried as (select k.res_id, rank, k.page_id, pg.page_id is null as missing, {DISTANCE.format(r=6371000.0, a='q', b='z')} as m
        from ranked k join (select res_id, lat, lng from resolutions) q on k.res_id = q.res_id left join pg on k.page_id = pg.page_id left join (select page_id, plat as lat, plng as lng from pg) z on k.page_id = z.page_id where rank <= 2),
    s as (select *, case when missing then 'fetch_failed' when m is null then 'unverified' when m <= 1000 then 'resolved' else 'too_far' end as status from tried),
    two as (select a.res_id, a.status as s1, a.page_id as p1, a.m as m1, b.status as s2, b.page_id as p2, b.m as m2 from s a left join s b on a.res_id = b.res_id and b.rank = 2 where a.rank = 1),
    best as (select res_id, s2 is null or s1 = 'resolved' or (s1 = 'too_far' and s2 = 'too_far' and m1 <= m2) as f, s1, p1, m1, s2, p2, m2 from two)
    select r.res_id as name_id, case when r.lat is null or r.lng is null then 'unlocated' when b.res_id is null then 'no_match' when f then s1 else s2 end as status,
      case when r.lat is null or r.lng is null or b.res_id is null then null when f then p1 else p2 end as page_id,
      round(case when r.lat is null or r.lng is null or b.res_id is null then null when f then m1 else m2 end, 3) as metres from resolutions r left join best b on r.res_id = b.res_id""")
def j_resolve(spark: SparkSession, d: str) -> DataFrame:
    r, refs = table(spark, d, "resolutions"), table(spark, d, "venue_refs").select("ref_id", "sweep_no", "name", "venue_id")
    cand = r.select(c("res_id").alias("name_id"), "sweep_no", "name").join(refs, ["sweep_no", "name"]).groupBy("name_id", c("venue_id").alias("page_id")).agg(F.min("ref_id").alias("first_ref"))
    # The best two are kept by partial aggregation, so a name with very many candidates needs no window over all of them.
    best = cand.groupBy("name_id").agg(F.min_by("page_id", "first_ref").alias("p1"), F.min("first_ref").alias("r1"))
    rest = cand.join(best, "name_id").where("first_ref > r1").groupBy("name_id").agg(F.min_by("page_id", "first_ref").alias("page_id"))
    ranked = best.select("name_id", c("p1").alias("page_id"), F.lit(1).alias("rank")).unionByName(rest.withColumn("rank", F.lit(2)))
    pages = sets.first_by(table(spark, d, "venues").where(PLACED).where("venue_id is not null").select(c("venue_id").alias("page_id"), "venue_key", "lat", "lng"), ["page_id"], ["venue_key"])
    out = matching.resolve_by_distance(r.select(c("res_id").alias("name_id"), "lat", "lng"), ranked, pages)
    return out.withColumn("metres", F.round("metres", 3))


@query("""select res_id, coalesce(status = 'resolved' and coalesce(venue_id, '') <> '' and row_number() over (partition by case when status = 'resolved' then venue_id end order by res_id) > 1, false) as duplicate from resolutions""")
def j_later_duplicates(spark: SparkSession, d: str) -> DataFrame:
    return matching.later_duplicates(table(spark, d, "resolutions"), "venue_id", c("status") == "resolved", ["res_id"]).select("res_id", "duplicate")


@query(f"""with {PINS}, o as (select *, (page_lng - pin_lng) * 111320 * cos(radians(pin_lat)) as e, (page_lat - pin_lat) * 111320 as n from pins where status in ('resolved', 'too_far'))
    select a.sweep_no, a.res_id, count(*) as support from o a join o b on a.sweep_no = b.sweep_no and a.res_id <> b.res_id
    where sqrt(a.e * a.e + a.n * a.n) <= 5000 and sqrt(pow(a.e - b.e, 2) + pow(a.n - b.n, 2)) <= 100
      and 2 * 6371000.0 * asin(least(1.0, sqrt(pow(sin(radians(b.pin_lat - a.pin_lat) / 2), 2) + cos(radians(a.pin_lat)) * cos(radians(b.pin_lat)) * pow(sin(radians(b.pin_lng - a.pin_lng) / 2), 2)))) <= 10000
    group by 1, 2 having count(*) >= 2""")
def j_shared_shifts(spark: SparkSession, d: str) -> DataFrame:
    """Every located pin with a page is taken as a miss, so that the rule has something to accept."""
    p = _resolved_pins(spark, d).where(c("status").isin("resolved", "too_far")).withColumn("status", F.lit("too_far"))
    return matching.shared_shifts(p, ["sweep_no"], "res_id")


@query("""with b as (select sweep_no, name, min(page_no) as x, min(length(name)) as y from venue_refs where page_no <= 20 and name is not null group by 1, 2 having count(*) = 1),
    a as (select sweep_no, name, min(page_no) as x, min(length(name)) as y from venue_refs where page_no > 20 and name is not null group by 1, 2 having count(*) = 1)
    select sweep_no, quantile_cont(a.x - b.x, 0.5) as dx, quantile_cont(a.y - b.y, 0.5) as dy, count(*) as shared from a join b using (sweep_no, name) group by 1""")
def j_surviving(spark: SparkSession, d: str) -> DataFrame:
    r = table(spark, d, "venue_refs").where("name is not null").select("sweep_no", "name", "page_no", c("page_no").alias("x"), F.length("name").alias("y"))
    return matching.surviving_displacement(r.where("page_no <= 20").drop("page_no"), r.where("page_no > 20").drop("page_no"), ["sweep_no"])


@query("""select venue_key, venue_id from venues v where not exists (select 1 from resolutions r where r.venue_id = v.venue_id and r.status = 'resolved')""")
def j_still_to_do(spark: SparkSession, d: str) -> DataFrame:
    journal = table(spark, d, "resolutions").select("venue_id", F.when(c("status") == "resolved", "ok").otherwise("failed").alias("status"))
    return matching.still_to_do(table(spark, d, "venues"), journal, "venue_id", ["venue_key"]).select("venue_key", "venue_id")


@query(f"""with k as (select lower(name) as name, arg_min(lat, osm_id) as lat, arg_min(lng, osm_id) as lng from osm_venues where name <> '' and {PLACED} group by 1)
    select v.venue_key, case when v.lat is null or v.lng is null then coalesce(k.lat, v.lat) else v.lat end as lat, case when v.lat is null or v.lng is null then coalesce(k.lng, v.lng) else v.lng end as lng,
    case when (v.lat is null or v.lng is null) and k.name is not null then 'cache' else v.geo_source end as geo_source from venues v left join k on lower(v.name) = k.name""")
def j_filled_in(spark: SparkSession, d: str) -> DataFrame:
    cache = table(spark, d, "osm_venues").where(c("name") != "").where(PLACED).groupBy(F.lower("name").alias("q")).agg(F.min_by("lat", "osm_id").alias("lat"), F.min_by("lng", "osm_id").alias("lng"))
    v = table(spark, d, "venues").select("venue_key", F.lower("name").alias("q"), "lat", "lng", "geo_source")
    return matching.filled_in(v, cache, "q").select("venue_key", "lat", "lng", "geo_source")


# Aggregates


@query("select count(*) as rows, round(avg(case when total is not null and uniques is not null and monthly is not null then 1.0 else 0.0 end), 9) as share from venues")
def a_quality(spark: SparkSession, d: str) -> DataFrame:
    good = c("total").isNotNull() & c("uniques").isNotNull() & c("monthly").isNotNull()
    return aggregates.quality_share(table(spark, d, "venues"), good).withColumn("share", F.round("share", 9))


@query("select city, count(*) as \"count\" from venue_refs where trim(city) <> '' group by city order by count(*) desc, min(ref_id) limit 1")
def a_modal_city(spark: SparkSession, d: str) -> DataFrame:
    return aggregates.modal_value(table(spark, d, "venue_refs"), "city", "ref_id")


VARIANT = "trim(regexp_replace(lower({}), '[^a-z]+', ' ', 'g'))"


@query(f"""with m as (select {VARIANT.format('city')} as k, count(*) as n from venue_refs where city is not null group by 1), ok as (select k, n, list_distinct(string_split(k, ' ')) as w from m where k <> ''),
    t as (select sum(n) as total from ok), cov as (select ok.* from ok, t where n >= 0.005 * total),
    h as (select a.k, c.k as head, row_number() over (partition by a.k order by len(c.w), c.n desc, c.k) as r from ok a join cov c on len(c.w) < len(a.w) and list_has_all(a.w, c.w)),
    f as (select coalesce(h.head, ok.k) as query, cast(sum(ok.n) as bigint) as places from ok left join h on ok.k = h.k and h.r = 1 group by 1)
    select query, places, round(places / total, 4) as share from f, t where places >= 0.002 * total order by places desc, query limit 10""")
def a_spelling_variants(spark: SparkSession, d: str) -> DataFrame:
    k = F.trim(F.regexp_replace(F.lower("city"), "[^a-z]+", " "))
    counts = table(spark, d, "venue_refs").where("city is not null").groupBy(k.alias("k")).agg(F.count("*").alias("n"))
    return aggregates.spelling_variants(counts, "k", "n", share=0.002)


@query("""with s as (select status, count(*) as size, count_if(coalesce(lat is not null, false)) as usable, count_if(lat is not null and coalesce(detail, '') = '') as errors from resolutions group by 1)
    select round(sum(case when usable > 0 then size * errors / usable end) / sum(case when usable > 0 then size end), 6) as rate, cast(coalesce(sum(case when usable > 0 then size end), 0) as double) as covered, count(case when usable < 5 then 1 end) as thin from s""")
def a_weighted_rate(spark: SparkSession, d: str) -> DataFrame:
    r = table(spark, d, "resolutions")
    sized = r.join(r.groupBy("status").agg(F.count("*").alias("size")), "status")
    return aggregates.weighted_rate(sized, "status", "size", c("lat").isNotNull(), F.coalesce("detail", F.lit("")) == "").withColumn("rate", F.round("rate", 6))


@query("""with r as (select status, res_id, count(*) over (partition by status) as n, row_number() over (partition by status order by md5('0|' || cast(res_id as varchar)), res_id) as k from resolutions)
    select status, res_id, n as _stratum_size from r where k <= 18""")
def a_stratified_sample(spark: SparkSession, d: str) -> DataFrame:
    return aggregates.stratified_sample(table(spark, d, "resolutions"), "status", "res_id", 18).select("status", "res_id", "_stratum_size")


@query(f"""with {PINS}, o as (select sweep_no, (page_lng - pin_lng) * 111320 * cos(radians(pin_lat)) as e, (page_lat - pin_lat) * 111320 as n from pins),
    m as (select sweep_no, median(e) as me, median(n) as mn from o group by 1), g as (select o.sweep_no, count(*) as matches, avg(case when sqrt(pow(e - me, 2) + pow(n - mn, 2)) <= 250 then 1.0 else 0.0 end) as s, any_value(me) as me, any_value(mn) as mn from o join m using (sweep_no) group by 1)
    select sweep_no, matches, round(case when matches >= 3 and s >= 0.6 then me end, 3) as e, round(case when matches >= 3 and s >= 0.6 then mn end, 3) as n from g""")
def a_agreed_offsets(spark: SparkSession, d: str) -> DataFrame:
    off = geo.planar_offset(c("pin_lat"), c("pin_lng"), c("page_lat"), c("page_lng"))
    p = _resolved_pins(spark, d).withColumn("o", off).select("sweep_no", c("o.east").alias("de"), c("o.north").alias("dn"))
    return aggregates.agreed_offsets(p, "sweep_no", "de", "dn").select("sweep_no", "matches", F.round("e", 3).alias("e"), F.round("n", 3).alias("n"))


@query("select sweep_no, status, count(*) as n, count(case when lat is null then 1 end) as unlocated from resolutions group by grouping sets ((sweep_no, status), (status), ())")
def a_status_summary(spark: SparkSession, d: str) -> DataFrame:
    table(spark, d, "resolutions").createOrReplaceTempView("lokalis_resolutions")
    return spark.sql("select sweep_no, status, count(*) as n, count_if(lat is null) as unlocated from lokalis_resolutions group by grouping sets ((sweep_no, status), (status), ())")


# Sequences


@query("""select res_id, last_value(venue_id ignore nulls) over (partition by sweep_no order by cell nulls last, res_id rows between unbounded preceding and current row) as carried from resolutions""")
def w_carried_forward(spark: SparkSession, d: str) -> DataFrame:
    return sequences.carried_forward(table(spark, d, "resolutions"), "venue_id", ["cell", "res_id"], ["sweep_no"]).select("res_id", "carried")


@query("""with e as (select *, case when event_type = 'error' then 1 else 0 end as bad, sum(case when event_type = 'error' then 0 else 1 end) over (partition by user_id order by ts, event_id rows unbounded preceding) as island from events)
    select event_id, cast(sum(bad) over (partition by user_id, island order by ts, event_id rows unbounded preceding) as bigint) as streak from e""")
def w_streaks(spark: SparkSession, d: str) -> DataFrame:
    return sequences.streaks(table(spark, d, "events"), c("event_type") == "error", ["ts", "event_id"], ["user_id"]).select("event_id", "streak")


@query("""select event_id, count(*) over (partition by user_id order by epoch_us(ts) // 1000000 range between 86400 preceding and current row) as recent from events""")
def w_rolling_count(spark: SparkSession, d: str) -> DataFrame:
    return sequences.rolling_count(table(spark, d, "events"), seconds("ts"), 86400, ["user_id"]).select("event_id", "recent")


@query("""with e as (select *, floor(value) - 50 as asked, case when event_type <> 'error' then floor(value * 1.1) - 50 end as measured from events),
    u as (select *, case when measured is not null and abs(asked) >= 20 then abs(measured) end as m, case when measured is not null and abs(asked) >= 20 then abs(asked) end as a from e)
    select event_id, round(case when coalesce(sum(a) over w, 0) = 0 then 1.0 else greatest(0.8, least(1.4, sum(m) over w / sum(a) over w)) end, 6) as ratio from u window w as (partition by user_id order by event_id rows between unbounded preceding and 1 preceding)""")
def w_running_ratio(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").withColumn("asked", F.floor("value") - 50).withColumn("measured", F.when(c("event_type") != "error", F.floor(c("value") * 1.1) - 50))
    return sequences.running_ratio(e, "measured", "asked", "event_id", ["user_id"], least=20).select("event_id", F.round("ratio", 6).alias("ratio"))


@query("""with p as (select event_id, user_id, cast(user_id % 7 as double) * 100 - 300 as dx, floor(value) - 50 as dy from events),
    a as (select *, 51.5 + sum(dy * 10.2 / 110540.0) over (partition by user_id order by event_id rows unbounded preceding) as cam_lat from p),
    b as (select *, -dx * 10.2 / (111320 * cos(radians(coalesce(lag(cam_lat) over (partition by user_id order by event_id), 51.5)))) as step from a)
    select event_id, round(cam_lat, 6) as cam_lat, round(-0.1 + sum(step) over (partition by user_id order by event_id rows unbounded preceding), 6) as cam_lng from b""")
def w_camera_track(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "events").select("event_id", "user_id", ((c("user_id") % 7) * 100.0 - 300).alias("dx"), (F.floor("value") - 50).alias("dy"))
    return sequences.camera_track(p, 51.5, -0.1, F.lit(10.2), ["user_id"], "event_id").select("event_id", F.round("cam_lat", 6).alias("cam_lat"), F.round("cam_lng", 6).alias("cam_lng"))


@query("""with recursive e as (select user_id, epoch_us(ts) // 1000000 as s from events where ts is not null), w(user_id, started) as (select user_id, min(s) from e group by 1
    union all select w.user_id, (select min(s) from e where e.user_id = w.user_id and e.s >= w.started + 3600) from w where (select min(s) from e where e.user_id = w.user_id and e.s >= w.started + 3600) is not null)
    select w.user_id, w.started, count(*) as events from w join e on e.user_id = w.user_id and e.s >= w.started and e.s < w.started + 3600 group by 1, 2""")
def w_activation_windows(spark: SparkSession, d: str) -> DataFrame:
    """Windows of an hour, each begun by the first event after the one before."""
    return sequences.activation_windows(table(spark, d, "events").withColumn("s", seconds("ts")), "user_id", "s").selectExpr("user_id", "cast(started as bigint) as started", "cast(events as bigint) as events")


@query("""select venue_key, geo_source = 'nominatim' or coalesce(1788220800 - epoch_us(fetched_at) // 1000000 < 2592000, false) as live from venues""")
def w_live_entries(spark: SparkSession, d: str) -> DataFrame:
    live = sequences.live_entries(table(spark, d, "venues"), seconds("fetched_at"), F.lit(1_788_220_800), 2592000, c("geo_source") == "nominatim")
    return table(spark, d, "venues").select("venue_key", live.alias("live"))


# Sets


@query("""select venue_id, venue_key, name, total from venues qualify row_number() over (partition by venue_id order by fetched_at desc, venue_key desc) = 1""")
def s_latest(spark: SparkSession, d: str) -> DataFrame:
    v = table(spark, d, "venues").select("venue_id", "venue_key", "name", "total", F.timestamp_diff("MICROSECOND", c("fetched_at"), F.lit("2100-01-01 00:00:00").cast("timestamp_ntz")).alias("o1"), (-c("venue_key")).alias("o2"))
    return sets.first_by(v, ["venue_id"], ["o1", "o2"]).drop("o1", "o2")


@query("""with r as (select venue_key as id, venue_id, name, address, 0 as b from venues union all select ref_id, venue_id, name, address, 1 from venue_refs),
    k as (select *, coalesce(nullif(venue_id, ''), concat_ws(' | ', name, nullif(trim(address), ''))) as key from r)
    select id, venue_id, name, address, count(*) over (partition by key) - 1 as duplicates from k qualify row_number() over (partition by key order by b, id) = 1""")
def s_merge_unique(spark: SparkSession, d: str) -> DataFrame:
    v = table(spark, d, "venues").select(c("venue_key").alias("id"), "venue_id", "name", "address")
    r = table(spark, d, "venue_refs").select(c("ref_id").alias("id"), "venue_id", "name", "address")
    return sets.merge_unique([v, r], ["id"])


FIELDS = ["total", "uniques", "monthly"]


@query(f"""with o as (select venue_id, max(row({', '.join(f"coalesce(cast({f} as varchar), '')" for f in FIELDS)})) as r from venues where month(fetched_at) % 2 = 0 group by 1),
    n as (select venue_id, max(row({', '.join(f"coalesce(cast({f} as varchar), '')" for f in FIELDS)})) as r from venues where month(fetched_at) % 2 = 1 group by 1)
    select venue_id, case when o.r is null then 'new' when n.r is null then 'gone' else 'changed' end as change from o full join n using (venue_id) where o.r is distinct from n.r""")
def s_run_diff(spark: SparkSession, d: str) -> DataFrame:
    v = table(spark, d, "venues")
    return sets.run_diff(v.where(F.month("fetched_at") % 2 == 0), v.where(F.month("fetched_at") % 2 == 1), "venue_id", FIELDS).select("venue_id", "change")


# Fits


@query(f"""with {PINS} select sweep_no, round(case when count(*) > 1 then regr_slope(page_lng, pin_lng) end, 4) as lng_per_x, round(case when count(*) > 1 then regr_slope(page_lat, pin_lat) end, 4) as lat_per_y from pins group by 1""")
def f_axis_lines(spark: SparkSession, d: str) -> DataFrame:
    p = _resolved_pins(spark, d)
    return fit.axis_lines(p, ["sweep_no"], "pin_lng", "pin_lat", "page_lat", "page_lng").select("sweep_no", F.round("lng_per_x", 4).alias("lng_per_x"), F.round("lat_per_y", 4).alias("lat_per_y"))


@query(f"""with {PINS}, l as (select sweep_no, pin_lng * 70000 as sx, pin_lat * 110540 as sy, page_lng * 70000 as dx, page_lat * 110540 as dy from pins), m as (select sweep_no, count(*) as n, avg(sx) ax, avg(sy) ay, avg(dx) bx, avg(dy) by_ from l group by 1),
    s as (select sweep_no, any_value(n) as n, sum(pow(sx - ax, 2) + pow(sy - ay, 2)) as den, sum((dx - bx) * (sx - ax) + (dy - by_) * (sy - ay)) as p, sum((dy - by_) * (sx - ax) - (dx - bx) * (sy - ay)) as q from l join m using (sweep_no) group by 1)
    select sweep_no, n, round(case when den > 1e-9 then p / den end, 4) + 0.0 as a_re, round(case when den > 1e-9 then q / den end, 4) + 0.0 as a_im from s""")
def f_similarity(spark: SparkSession, d: str) -> DataFrame:
    p = _resolved_pins(spark, d).select("sweep_no", (c("pin_lng") * 70000).alias("sx"), (c("pin_lat") * 110540).alias("sy"), (c("page_lng") * 70000).alias("dx"), (c("page_lat") * 110540).alias("dy"))
    return fit.similarity(p, ["sweep_no"], "sx", "sy", "dx", "dy").select("sweep_no", "n", (F.round("a_re", 4) + 0.0).alias("a_re"), (F.round("a_im", 4) + 0.0).alias("a_im"))


@query()
def f_robust_fits(spark: SparkSession, d: str) -> DataFrame:
    p = _resolved_pins(spark, d)
    at = lambda lat, lng: geo.to_local(lat, lng, F.round(c("pin_lat"), 0), F.round(c("pin_lng"), 0))
    s, t = at(c("pin_lat"), c("pin_lng")), geo.to_local(c("page_lat"), c("page_lng"), F.round(c("pin_lat"), 0), F.round(c("pin_lng"), 0))
    return fit.robust_fits(p.select("sweep_no", s["e"].alias("sx"), s["n"].alias("sy"), t["e"].alias("dx"), t["n"].alias("dy")), "sweep_no")


@query(f"""with {PINS}, o as (select sweep_no, cell, (page_lng - pin_lng) * 111320 * cos(radians(46.6)) as e, (page_lat - pin_lat) * 110540 as n from pins),
    m as (select sweep_no, cell, median(e) as me, median(n) as mn from o group by 1, 2),
    g as (select o.sweep_no, o.cell, any_value(me) as me, any_value(mn) as mn from o join m on o.sweep_no = m.sweep_no and o.cell is not distinct from m.cell group by 1, 2 having count(*) >= 3 and avg(case when sqrt(pow(e - me, 2) + pow(n - mn, 2)) <= 250 then 1.0 else 0.0 end) >= 0.6),
    k as (select c.sweep_no, c.cell, g.me, g.mn, last_value(g.me ignore nulls) over w as ce, last_value(g.mn ignore nulls) over w as cn from (select distinct sweep_no, cell from resolutions) c left join g on c.sweep_no = g.sweep_no and c.cell is not distinct from g.cell
        window w as (partition by c.sweep_no order by c.cell nulls last rows between unbounded preceding and current row))
    select r.res_id, r.sweep_no, r.cell, round(case when ce is not null and lat is not null then lat + cn / 110540 else lat end, 6) as lat, round(case when ce is not null and lat is not null then lng + ce / (111320 * cos(radians(46.6))) else lng end, 6) as lng,
      case when me is not null then 'anchored' when ce is not null then 'carried' else 'unmeasured' end as anchor from resolutions r join k on r.sweep_no = k.sweep_no and r.cell is not distinct from k.cell""")
def f_anchored_cells(spark: SparkSession, d: str) -> DataFrame:
    r = table(spark, d, "resolutions").select("res_id", "sweep_no", "cell", "lat", "lng")
    m = _resolved_pins(spark, d).select("sweep_no", "cell", c("pin_lat").alias("lat"), c("pin_lng").alias("lng"), c("page_lat").alias("known_lat"), c("page_lng").alias("known_lng"))
    return fit.anchored_cells(r, m, F.lit(46.6), F.lit(-1.0), ["sweep_no"]).withColumns({"lat": F.round("lat", 6), "lng": F.round("lng", 6)})


@query(f"""with {PINS}, d as (select a.sweep_no, sqrt(pow(a.pin_lng - b.pin_lng, 2) + pow(a.pin_lat - b.pin_lat, 2)) as px, sqrt(pow(a.page_lng - b.page_lng, 2) + pow(a.page_lat - b.page_lat, 2)) as m
    from pins a join pins b on a.sweep_no = b.sweep_no and a.res_id < b.res_id), s as (select distinct sweep_no from pins)
    select s.sweep_no, round(w.scale, 5) as scale from s left join (select sweep_no, arg_max(m / px, px) as scale from d where px >= 0.001 group by 1) w using (sweep_no)""")
def f_widest_scale(spark: SparkSession, d: str) -> DataFrame:
    """Page distance over pin distance of the pins farthest apart in each sweep (degrees times a thousand as pixels)."""
    p = _resolved_pins(spark, d).select("sweep_no", (c("pin_lng") * 1000).alias("x"), (c("pin_lat") * 1000).alias("y"), (c("page_lng") * 1000).alias("e"), (c("page_lat") * 1000).alias("n"))
    return fit.widest_scale(p, ["sweep_no"]).select("sweep_no", F.round("m_per_px", 5).alias("scale"))


@query()
def h_harvest(spark: SparkSession, d: str) -> DataFrame:
    """What an adaptive harvest of the busiest metropolitan area finds of its pages."""
    v = table(spark, d, "venues").where(PLACED).select("venue_key", "name", "total", "lat", "lng")
    rows, _ = harvest.quadtree_harvest(v, (-1.1, -0.9, 46.5, 46.7), key="venue_key")
    return rows


@query("""with c as (select city_id, metro_lat as y, metro_lng as x from cities) select v.venue_key, c.city_id as polygon from venues v join c on v.lat is not null and v.lng is not null and not (v.lat = 0 and v.lng = 0)
    and abs(v.lat) <= 90 and abs(v.lng) <= 180 and abs(v.lat - y) / 0.1 + abs(v.lng - x) / 0.15 < 1""")
def h_polygons(spark: SparkSession, d: str) -> DataFrame:
    """Pages inside a diamond around each metropolitan centre."""
    y, x = c("metro_lat"), c("metro_lng")
    rings = table(spark, d, "cities").select(c("city_id").alias("polygon"), F.lit(0).alias("ring"), F.array(y + 0.1, y, y - 0.1, y).alias("lat"), F.array(x, x + 0.15, x, x - 0.15).alias("lng"))
    return harvest.in_polygons(table(spark, d, "venues"), rings, "venue_key")


@query()
def k_features(spark: SparkSession, d: str) -> DataFrame:
    """Every placed page as a GeoJSON feature, a KML placemark and a GPX waypoint."""
    v = maps.located(table(spark, d, "venues")).withColumn("unique", c("uniques")).withColumn("url", F.lit(""))
    return v.select("venue_key", maps.feature().alias("geojson"), maps.placemark().alias("kml"), maps.waypoint().alias("gpx"))


@query("""select res_id, substr(sha256('https://search.example/v?page=' || cast(cell as varchar) || '&sweep=' || cast(sweep_no as varchar)), 1, 32) as key from resolutions""")
def t_request_key(spark: SparkSession, d: str) -> DataFrame:
    params = F.create_map(F.lit("sweep"), c("sweep_no").cast("string"), F.lit("page"), c("cell").cast("string"))
    return table(spark, d, "resolutions").select("res_id", text.request_key(F.lit("https://search.example/v"), params, 32).alias("key"))


@query(f"""with o as (select 46.6 as lat, -1.0 as lng), k as (select v.name, {DISTANCE.format(r=6371.0088, a='o', b='v')} as km from osm_venues v, o where v.name <> '' and regexp_matches(v.name, '[^ ]'))
    select arg_min(name, km) as name, round(min(km), 6) as km from k where km <= 8 group by lower(name) order by min(km), lower(name) limit 60""")
def h_nearest_names(spark: SparkSession, d: str) -> DataFrame:
    return harvest.nearest_names(table(spark, d, "osm_venues"), 46.6, -1.0, 8.0).withColumn("km", F.round("km", 6))


@query("""with r as (select *, row_number() over (partition by search_term order by page_no, ref_id) as pos from venue_refs), k as (select *, coalesce(contains(lower(city), substr(search_term, 1, 5)), false) as here from r where pos <= 1000)
    select search_term, any_value(total) as total, count(case when here then 1 end) as collected, count(case when not here then 1 end) as other_place from k join (select search_term, count(*) as total from venue_refs group by 1) t using (search_term) group by 1""")
def h_harvest_stats(spark: SparkSession, d: str) -> DataFrame:
    here = F.contains(F.lower("city"), F.substring("search_term", 1, 5))
    return harvest.harvested(table(spark, d, "venue_refs"), "search_term", "venue_id", ["page_no", "ref_id"], here)[1]


@query("select city, count(*) as places from venues where lat between 46.5 and 46.7 and lng between -1.1 and -0.9 group by city")
def h_counted_in_box(spark: SparkSession, d: str) -> DataFrame:
    return harvest.counted_in_box(table(spark, d, "venues"), 46.5, 46.7, -1.1, -0.9, "city")
