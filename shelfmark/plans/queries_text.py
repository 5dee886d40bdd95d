"""Queries over URL, HTML, price and title operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import price as P
from ..functions import text as T
from ..functions import urls as U
from ..operators import html as H
from ..operators import urls as UF
from ..operators.catalog import reformat_prices, require_price
from .registry import query, table
from .shop import shop_columns, shop_pages, shop_sql, spread_parts

SHOP = shop_sql()


def stored_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages")


# ---------------------------------------------------------------- DuckDB fragments

# Character references that occur in the stored pages.
_REFERENCES = [("&copy;", "©"), ("&middot;", "·"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#x27;", "''"), ("&#39;", "''"), ("&amp;", "&")]


def decoded(sql: str) -> str:
    for ref, char in _REFERENCES:
        sql = f"replace({sql}, '{ref}', '{char}')"
    return sql


URL_CTE = r"""
u as (select page_id, url,
  regexp_extract(url, '^([a-z]+)://', 1) as scheme,
  regexp_extract(url, '^[a-z]+://([^/?#]*)', 1) as netloc,
  regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1) as path,
  regexp_extract(url, '^[^?#]*\?([^#]*)', 1) as query,
  regexp_extract(url, '^[^#]*#(.*)$', 1) as fragment
  from pages)"""

LINKS_CTE = f"""
found as (select page_id, url as src_url, regexp_extract_all(html, '(?i)<a href="([^"]*)"', 1) as hrefs from pages),
links as (select page_id, src_url, unnest(range(len(hrefs))) as pos, {decoded("unnest(hrefs)")} as href from found)"""

HTML_TITLE = (
    "coalesce(nullif("
    + decoded("regexp_extract(html, '(?is)<title[^>]*>(.*?)</title', 1)")
    + ", ''), 'No title found')"
)

# ---------------------------------------------------------------- URLs


@query("url_parts", f"with {URL_CTE} select page_id, scheme, netloc, path, query, fragment from u")
def _(spark, sf_dir):
    pages = table(spark, sf_dir, "pages")
    return pages.select("page_id", U.url_parts(F.col("url")).alias("u")).select("page_id", "u.*")


@query("site_key", f"with {URL_CTE} select page_id, replace(netloc, 'www.', '') as site from u")
def _(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", U.site_key(F.col("url")).alias("site"))


@query("defragment", r"select page_id, regexp_replace(url, '#.*$', '') as url from pages")
def _(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", U.defragment(F.col("url")).alias("url"))


@query(
    "resolve_url_root",
    f"with {LINKS_CTE} select l.page_id, l.pos, "
    "regexp_extract(src_url, '^[a-z]+://[^/?#]*', 0) || href as dst_url from links l",
)
def _(spark, sf_dir):
    links = H.extract_links(stored_pages(spark, sf_dir))
    root = F.concat(U.scheme(F.col("src_url")), F.lit("://"), U.netloc(F.col("src_url")), F.lit("/"))
    return links.select("page_id", "pos", U.resolve_url(root, F.col("href")).alias("dst_url"))


_HREF = (
    "case p_partkey % 10 when 0 then concat('/p/', {k}, '#x') when 1 then concat('rel/', {k}) "
    "when 2 then concat('../up/', {k}, '?a=1') when 3 then concat('?q=', {k}) when 4 then concat('#f', {k}) "
    "when 5 then concat('//other.example/', {k}) when 6 then concat('http://abs.example/', {k}, '/../x') "
    "when 7 then '' when 8 then concat('./', {k}, '/./') else concat('/x/y/../', {k}, '/..') end"
)
_BASE = "concat('https://shop.example/a/b/', {k}, '?s=1')"


@query(
    "resolve_url_page",
    "with k as (select p_partkey, cast(p_partkey as varchar) as k from part) select p_partkey, "
    "case p_partkey % 10 when 0 then 'https://shop.example/p/' || k || '#x' "
    "when 1 then 'https://shop.example/a/b/rel/' || k when 2 then 'https://shop.example/a/up/' || k || '?a=1' "
    "when 3 then 'https://shop.example/a/b/' || k || '?q=' || k "
    "when 4 then 'https://shop.example/a/b/' || k || '?s=1#f' || k when 5 then 'https://other.example/' || k "
    "when 6 then 'http://abs.example/' || k || '/../x' when 7 then 'https://shop.example/a/b/' || k || '?s=1' "
    "when 8 then 'https://shop.example/a/b/' || k || '/' else 'https://shop.example/x/' end as dst_url from k",
)
def _(spark, sf_dir):
    key = "cast(p_partkey as string)"
    part = table(spark, sf_dir, "part").selectExpr(
        "p_partkey", f"{_HREF.format(k=key)} as href", f"{_BASE.format(k=key)} as base"
    )
    return part.select("p_partkey", U.resolve_url(F.col("base"), F.col("href")).alias("dst_url"))


@query(
    "same_site",
    f"with {URL_CTE} select page_id, netloc = "
    "(select regexp_extract(url, '^[a-z]+://([^/?#]*)', 1) from pages where page_id = 0) as same from u",
)
def _(spark, sf_dir):
    pages = table(spark, sf_dir, "pages")
    root = pages.filter("page_id = 0").select("url").first()[0]
    return pages.select("page_id", U.same_site(F.col("url"), root).alias("same"))


_FILE = "concat('/f', {k}, case p_partkey % 6 when 0 then '.PDF' when 1 then '.tar.gz' when 2 then '.html' when 3 then '.pdf?y=1' when 4 then '?f=x.pdf' else '/' end)"


@query(
    "only_html_pages",
    "with f as (select p_partkey, 'https://a.example' || "
    + _FILE.format(k="cast(p_partkey as varchar)")
    + " as url from part) select p_partkey, url from f where p_partkey % 6 in (2, 4, 5)",
)
def _(spark, sf_dir):
    files = table(spark, sf_dir, "part").selectExpr(
        "p_partkey", f"concat('https://a.example', {_FILE.format(k='cast(p_partkey as string)')}) as url"
    )
    return UF.only_html_pages(files)


@query("exclude_links", "select page_id, url from pages where url not in (select url from pages where page_id % 4 = 0)")
def _(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return UF.exclude_links(pages, pages.filter("page_id % 4 = 0").select("url"))


@query("exclude_containing_query", f"with {URL_CTE} select page_id, url from u where not contains(query, 'ref=')")
def _(spark, sf_dir):
    return UF.exclude_containing(table(spark, sf_dir, "pages").select("page_id", "url"), "ref=", "query")


@query("exclude_containing_url", "select page_id, url from pages where not contains(url, '/en/')")
def _(spark, sf_dir):
    return UF.exclude_containing(table(spark, sf_dir, "pages").select("page_id", "url"), "/en/")


@query("exclude_containing_nothing", "select page_id, url from pages")
def _(spark, sf_dir):
    return UF.exclude_containing(table(spark, sf_dir, "pages").select("page_id", "url"), "")


@query(
    "video_embed",
    "select p_partkey, 'v' || p_partkey as video_id, 'https://www.youtube.com/embed/v' || p_partkey as embed from part",
)
def _(spark, sf_dir):
    links = table(spark, sf_dir, "part").selectExpr(
        "p_partkey", "concat('https://www.youtube.com/watch?v=v', p_partkey) as link"
    )
    link = F.col("link")
    return links.select("p_partkey", U.video_id(link).alias("video_id"), U.video_embed(link).alias("embed"))


# ---------------------------------------------------------------- prices and titles

_PRICE_CASES = (
    "case p_partkey % 6 when 0 then concat({p}, ' €') when 1 then replace({p}, '.', ',') "
    "when 2 then concat('7,95€ El precio original era: 7,95€.El precio actual es: ', replace({p}, '.', ','), '€') "
    "when 3 then concat(replace({p}, '.', ','), '€ El precio original era: 9,00€') "
    "when 4 then 'gratis' else concat('1.', replace({p}, '.', ','), '€') end"
)
_P = "cast(cast(p_retailprice as decimal(18,2)) as {T})"
_CASES_SQL = f"""cases as (select p_partkey, {_P.format(T='varchar')} as p,
  {_PRICE_CASES.format(p=_P.format(T='varchar'))} as price from part)"""
# the price with a comma after the thousands, as the first version prints it
_GROUPED = (
    "case when len(split_part(p, '.', 1)) > 3 then left(p, len(p) - 6) || ',' || right(p, 6) else p end"
)


def price_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").selectExpr(
        "p_partkey", f"{_PRICE_CASES.format(p=_P.format(T='string'))} as price"
    )


@query(
    "price_eur",
    f"with {_CASES_SQL} select p_partkey, case when p_partkey % 6 in (0, 1) then p || '€' else price end as price from cases",
)
def _(spark, sf_dir):
    return reformat_prices(price_cases(spark, sf_dir), "eur")


@query(
    "price_amount",
    f"with {_CASES_SQL} select p_partkey, case when p_partkey % 6 in (0, 1) then p "
    "when p_partkey % 6 = 5 and len(p) = 6 then '1' || p end as amount from cases",
)
def _(spark, sf_dir):
    amount = P.price_amount(F.col("price")).cast("string")
    return price_cases(spark, sf_dir).select("p_partkey", amount.alias("amount"))


@query(
    "price_current",
    f"with {_CASES_SQL} select p_partkey, case when p_partkey % 6 in (0, 1, 2, 3) "
    f"then replace({_GROUPED}, '.', ',') || '€' else price end as price from cases",
)
def _(spark, sf_dir):
    return reformat_prices(price_cases(spark, sf_dir), "current")


@query(
    "price_last",
    rf"with {_CASES_SQL} select p_partkey, coalesce(regexp_extract_all(price, '(\d+,\d{{2}}€)', 1)[-1], price) as price from cases",
)
def _(spark, sf_dir):
    return reformat_prices(price_cases(spark, sf_dir), "last")


@query("require_price", f"with {SHOP} select page_id, price_text_v1 as price from shop where price_text_v1 is not null")
def _(spark, sf_dir):
    prices = shop_columns(spark, sf_dir, "page_id", "price_text_v1").withColumnRenamed("price_text_v1", "price")
    return require_price(prices)


@query(
    "title_head",
    rf"with {SHOP} select page_id, regexp_split_to_array(nullif(og_title, ''), '\s[-|]\s')[1] as name from shop",
)
def _(spark, sf_dir):
    titles = shop_columns(spark, sf_dir, "page_id", "og_title")
    return titles.select("page_id", T.title_head(F.col("og_title")).alias("name"))


# ---------------------------------------------------------------- elements and links of stored pages

# Comments and whole scripts and styles, then tags; text between them is left out.
_TAG_TOKENS = r"""regexp_extract_all(html, '(?is)<!--.*?-->|<script\b[^>]*>.*?</script\s*>|<style\b[^>]*>.*?</style\s*>|</?[a-z][^<>]*>|<![^>]*>', 0)"""


@query(
    "elements",
    f"with t as (select unnest({_TAG_TOKENS}) as raw from pages), "
    r"k as (select case when raw like '<!%' then 'comment' when raw ilike '<script%' or raw ilike '<style%' then 'raw' "
    r"when raw like '</%' then 'close' else 'open' end as kind, "
    r"lower(regexp_extract(raw, '^</?([a-zA-Z][^\s/>]*)', 1)) as tag from t) "
    "select kind, nullif(tag, '') as tag, count(*) as n from k group by all",
)
def _(spark, sf_dir):
    rows = H.elements(stored_pages(spark, sf_dir)).filter("kind <> 'text'")
    return rows.groupBy("kind", "tag").agg(F.count(F.lit(1)).alias("n"))


@query(
    "elements_rows",
    f"with t as (select page_id, {_TAG_TOKENS.replace("<![^>]*>'", "<![^>]*>|[^<]+'")} as raws from pages), "
    "u as (select page_id, unnest(range(len(raws))) as pos, unnest(raws) as raw from t), "
    r"k as (select *, case when raw like '<!%' then 'comment' when regexp_matches(raw, '(?i)^<(script|style)\b') then 'raw' "
    r"when raw like '</%' then 'close' when raw like '<%' then 'open' else 'text' end as kind from u) "
    "select page_id, pos, kind, case when kind in ('open', 'close', 'raw') then "
    r"lower(regexp_extract(raw, '^</?([a-zA-Z][^\s/>]*)', 1)) end as tag, "
    r"case when kind in ('open', 'raw') then trim(regexp_extract(raw, '^<[a-zA-Z][^\s/>]*([^>]*)>', 1)) end as attrs, "
    f"case when kind = 'text' then {decoded('raw')} "
    r"when kind = 'raw' then regexp_extract(raw, '(?is)^<[^>]*>(.*)</(?:script|style)\s*>$', 1) end as text from k",
)
def _(spark, sf_dir):
    return H.elements(stored_pages(spark, sf_dir))


@query(
    "elements_text",
    "select page_id, "
    + decoded(
        r"regexp_replace(regexp_replace(html, '(?is)<!--.*?-->|<script\b.*?</script\s*>|<style\b.*?</style\s*>', '', 'g'), '(?is)</?[a-z][^<>]*>|<![^>]*>', '', 'g')"
    )
    + " as text from pages",
)
def _(spark, sf_dir):
    # all text of a page in order, put together from the array without moving it
    t = F.col("tokens")
    return H.with_tokens(stored_pages(spark, sf_dir)).select("page_id", H.inner_text(t).alias("text"))


@query("extract_links", f"with {LINKS_CTE} select page_id, src_url, pos, href from links")
def _(spark, sf_dir):
    return H.extract_links(stored_pages(spark, sf_dir))


@query("html_title", f"select page_id, {HTML_TITLE} as title from pages")
def _(spark, sf_dir):
    title = F.coalesce(H.html_title(F.col("html")), F.lit(H.NO_HTML_TITLE))
    return stored_pages(spark, sf_dir).select("page_id", title.alias("title"))


@query(
    "first_tag_text",
    "select page_id, trim(" + decoded("regexp_extract(html, '(?is)<h1[^>]*>(.*?)</h1', 1)") + ") as heading from pages",
)
def _(spark, sf_dir):
    heading = H.first_by_class([H.Selector("h1")], any_class=True, first_match_wins=True)
    return H.with_tokens(stored_pages(spark, sf_dir)).select("page_id", heading.alias("heading"))


_PLAIN = r"html"
for _pattern, _with in [
    (r"(?is)<!--.*?-->|<script\b.*?</script\s*>|<style\b.*?</style\s*>|<![^>]*>", ""),
    (r"(?is)<nav\b[^>]*>.*?</nav\s*>|<footer\b[^>]*>.*?</footer\s*>", ""),
]:
    _PLAIN = f"regexp_replace({_PLAIN}, '{_pattern}', '{_with}', 'g')"
_PLAIN = rf"regexp_replace({_PLAIN}, '[ \t\r\n\f]+', ' ', 'g')"
_PLAIN = rf"regexp_replace({_PLAIN}, '(?i)</?(?:{'|'.join(H.BLOCK_TAGS)})(?:[\s/][^<>]*)?>', chr(10) || chr(10), 'g')"
_PLAIN = rf"regexp_replace({_PLAIN}, '(?i)</?br(?:[\s/][^<>]*)?>', chr(10), 'g')"
_PLAIN = r"regexp_replace(" + _PLAIN + r", '(?i)</?[a-z][^<>]*>', '', 'g')"
_PLAIN = decoded(_PLAIN)
_PLAIN = rf"regexp_replace({_PLAIN}, ' *(\n+) *', '\1', 'g')"
_PLAIN = rf"regexp_replace({_PLAIN}, '\n{{3,}}', chr(10) || chr(10), 'g')"
_PLAIN = rf"regexp_replace({_PLAIN}, '^\s+|\s+$', '', 'g')"


@query("page_text", f"select page_id, {_PLAIN} as text from pages")
def _(spark, sf_dir):
    return H.page_text(stored_pages(spark, sf_dir)).select("page_id", "text")


# The rewrite rules without look-around: single line breaks become spaces, empty lines go, then
# the signs. The stored pages hold none of the link marks that the other rules remove.
_MARK = "chr(1)"
_CLEANED = rf"replace(replace(replace({_PLAIN}, chr(10) || chr(10), {_MARK}), chr(10), ' '), {_MARK}, chr(10))"
_CLEANED = rf"regexp_replace({_CLEANED}, '(?m)\s*!\s*$', '', 'g')"
_CLEANED = rf"replace(regexp_replace({_CLEANED}, '\s+!', ' ', 'g'), '~', '')"


@query("page_text_cleaned", f"select page_id, {_CLEANED} as text from pages")
def _(spark, sf_dir):
    return H.page_text(stored_pages(spark, sf_dir), cleaned=True).select("page_id", "text")


@query(
    "script_stats",
    r"""with s as (select page_id, html, regexp_extract_all(regexp_replace(html, '(?s)<!--.*?-->', '', 'g'),
      '(?is)<script([^>]*)>(?:.*?)</script', 1) as attrs,
      regexp_extract_all(regexp_replace(html, '(?s)<!--.*?-->', '', 'g'), '(?is)<script(?:[^>]*)>(.*?)</script', 1) as bodies
      from pages)
    select page_id, cast(len(list_filter(attrs, lambda a: contains(a, 'src='))) as bigint) as external_scripts,
      cast(coalesce(list_sum(list_transform(bodies, lambda b: len(b))), 0) as bigint) as inline_chars,
      regexp_matches(html, 'data-reactroot|data-reactid|ng-app|ng-controller|v-bind|v-model') as framework from s""",
)
def _(spark, sf_dir):
    return H.script_stats(stored_pages(spark, sf_dir)).drop("url")


@query(
    "is_js_heavy",
    f"with {SHOP} select page_id, external_scripts, external_scripts > 5 as js_heavy from shop",
)
def _(spark, sf_dir):
    heavy = H.is_js_heavy(shop_pages(spark, sf_dir))
    return heavy.select("page_id", "external_scripts", "js_heavy")


_SCRIPTED = (
    "concat('<html><head>', case when p_partkey % 9 = 1 then '<div data-reactid=1></div>' when p_partkey % 9 = 4 then '<p ng-app>' "
    "when p_partkey % 9 = 7 then '<p v-model=\"x\">' else '<p>' end, repeat('<script src=/s.js></script>', cast(p_partkey % 8 as int)), "
    "'<script>', repeat('x', cast((p_partkey * 97) % 25000 as int)), '</script><!-- <script src=a></script> -->')"
)


@query(
    "is_js_heavy_all",
    "select p_partkey as page_id, p_partkey % 8 as external_scripts, (p_partkey * 97) % 25000 as inline_chars, "
    "p_partkey % 9 in (1, 4, 7) as framework, "
    "p_partkey % 9 in (1, 4, 7) or p_partkey % 8 > 5 or (p_partkey * 97) % 25000 > 20000 as js_heavy from part",
)
def _(spark, sf_dir):
    """Pages of all branches: marks of three frameworks, many scripts, long ones, and their limits."""
    part, _ = spread_parts(spark, sf_dir)
    pages = part.selectExpr("p_partkey as page_id", "'https://a.example/' as url", f"{_SCRIPTED} as html")
    return H.is_js_heavy(pages).drop("url")


# ---------------------------------------------------------------- fields of shop pages


@query("meta_property", f"with {SHOP} select page_id, og_title as content from shop where og_title is not null")
def _(spark, sf_dir):
    return H.meta_property(shop_pages(spark, sf_dir), "og:title")


def shop_field(spark: SparkSession, sf_dir: str, name: str, field: Column) -> DataFrame:
    pages = H.with_tokens(shop_pages(spark, sf_dir))
    return pages.select("page_id", field.alias(name))


@query("first_by_class", f"with {SHOP} select page_id, div_description as text from shop")
def _(spark, sf_dir):
    selectors = [H.Selector("span", "missing"), H.Selector("div", "value"), H.Selector("p", "price")]
    return shop_field(spark, sf_dir, "text", H.first_by_class(selectors))


@query("page_title", f"with {SHOP} select page_id, title from shop")
def _(spark, sf_dir):
    return shop_field(spark, sf_dir, "title", H.page_title())


@query("page_title_no_og", "select p_partkey as page_id, p_name as title from part")
def _(spark, sf_dir):
    return shop_field(spark, sf_dir, "title", H.page_title(H.Rules(use_og_title=False)))


@query("page_title_v1", f"with {SHOP} select page_id, title from shop")
def _(spark, sf_dir):
    return shop_field(spark, sf_dir, "title", H.page_title_v1())


@query("page_image", f"with {SHOP} select page_id, coalesce(image, 'Image not found') as image from shop")
def _(spark, sf_dir):
    return H.with_sentinels(shop_field(spark, sf_dir, "image", H.page_image()))


@query("page_image_v1", f"with {SHOP} select page_id, coalesce(og_image, 'Imagen no disponible') as image from shop")
def _(spark, sf_dir):
    return H.with_sentinels(shop_field(spark, sf_dir, "image", H.page_image_v1()), H.SENTINELS_V1)


@query("page_description", f"with {SHOP} select page_id, description from shop")
def _(spark, sf_dir):
    return shop_field(spark, sf_dir, "description", H.page_description())


@query("page_description_v1", "select p_partkey as page_id, p_name || ' of ' || p_brand as description from part")
def _(spark, sf_dir):
    return shop_field(spark, sf_dir, "description", H.page_description_v1())


@query("page_price_text", f"with {SHOP} select page_id, price_text as price from shop")
def _(spark, sf_dir):
    return shop_field(spark, sf_dir, "price", H.page_price_text())


@query(
    "page_price_text_v1",
    f"with {SHOP} select page_id, coalesce(price_text_v1, 'Precio no disponible') as price from shop",
)
def _(spark, sf_dir):
    return H.with_sentinels(shop_field(spark, sf_dir, "price", H.page_price_text_v1()), H.SENTINELS_V1)


@query("script_price", f"with {SHOP} select page_id, script_price as price from shop")
def _(spark, sf_dir):
    return shop_field(spark, sf_dir, "price", H.script_price())


@query(
    "strict_og",
    f"with {SHOP} select page_id, url, og_title as title, og_image as image, og_description as description from shop "
    "where og_title is not null and og_image is not null and og_description is not null",
)
def _(spark, sf_dir):
    return H.strict_og(shop_pages(spark, sf_dir))


@query(
    "status_title",
    f"with {SHOP} select page_id, case when page_id % 9 = 0 then 'Status code: 404' else title end as title from shop",
)
def _(spark, sf_dir):
    pages = shop_pages(spark, sf_dir).withColumn("status", F.expr("if(page_id % 9 = 0, 404, 200)"))
    return H.extract_fields(pages).select("page_id", "title")


@query(
    "product_details",
    f"with {SHOP} select url, title, image, description, case "
    "when price_text = '0,00€' then '0.00€' when price_text like 'El%' then price_text "
    "else replace(replace(price_text, ',', '.'), ' ', '') end as price from shop where page_id % 2 = 0",
)
def _(spark, sf_dir):
    titles = shop_columns(spark, sf_dir, "page_id", "url", "title").filter("page_id % 2 = 0")
    return H.product_details(shop_pages(spark, sf_dir), titles).drop("price_amount")


@query(
    "clean_text",
    # line breaks of the rules only: the built text has none of the link marks
    "select p_partkey, p_name || 'ab' || p_brand || ' x' || p_type || chr(10) || 'end y' as text from part",
)
def _(spark, sf_dir):
    raw = table(spark, sf_dir, "part").selectExpr(
        "p_partkey",
        "concat(p_name, 'a-', chr(10), 'b~', p_brand, chr(10), 'x', p_type, ' !', chr(10), chr(10), "
        "'end !y[a](b)![](c)') as text",
    )
    return raw.select("p_partkey", T.clean_text(F.col("text")).alias("text"))


@query(
    "price_eur_long",
    "select p_partkey, case when p_partkey % 2 = 0 then '9' || p_partkey || '12345678901234567.50€' else '0.00€' end as price from part",
)
def _(spark, sf_dir):
    """Long amounts, and one that rounding twice would raise."""
    prices = table(spark, sf_dir, "part").selectExpr(
        "p_partkey", "if(p_partkey % 2 = 0, concat('9', p_partkey, '12345678901234567,5 €'), '0,0049999999999 €') as price"
    )
    return reformat_prices(prices, "eur")


@query(
    "decode_references",
    "select p_partkey, 'it''s © ' || p_name || ' café é é &copy=1 &copyx &bogus; &' as text from part",
)
def _(spark, sf_dir):
    """References without a semicolon, with leading zeros, and what only looks like one."""
    text = F.concat(F.lit("it&apos;s &copy "), F.col("p_name"), F.lit(" caf&eacute &#00000233; &#xE9 &copy=1 &copyx &bogus; &amp"))
    return table(spark, sf_dir, "part").select("p_partkey", T.decode_references(text).alias("text"))
