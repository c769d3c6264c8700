"""Parsers of board payloads: ``(company, token, payload)`` rows to canonical postings.

Fetching and parsing are apart: a payload is text, so every parser is column expressions (Python only to resolve HTML
entities and to cut a page's embedded JSON) and runs without a network. A payload that is not what its board
sends gives no posting; :func:`payload_error` says why.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from heddle.functions.dates import iso_from_dotted, iso_from_millis
from heddle.functions.html import assigned_json, clean, json_first_key, one_line, strip_tags, unescape
from heddle.functions.names import known, strip, text
from heddle.operators.merge import first_per_key

POSTING = ("company", "ats", "job_id", "title", "location", "url", "department", "work_type", "posted_at", "raw")

GREENHOUSE = "struct<jobs:array<struct<id:bigint,title:string,absolute_url:string,location:string,departments:array<string>,metadata:string,first_published:string>>>"
LEVER = "array<struct<id:string,text:string,categories:string,applyUrl:string,hostedUrl:string,workplaceType:string,createdAt:string>>"
ASHBY = "array<struct<id:string,title:string,isListed:boolean,locationName:string,locationExternalName:string,departmentName:string,departmentExternalName:string,workplaceType:string,publishedDate:string>>"
_WORKABLE_JOB = "array<struct<id:string,shortcode:string,title:string,location:struct<city:string,region:string,country:string>,department:string,workplace:string,remote:boolean,published:string>>"
WORKABLE = f"struct<results:{_WORKABLE_JOB},jobs:{_WORKABLE_JOB}>"
SMARTRECRUITERS = "struct<content:array<struct<id:string,name:string,releasedDate:string,location:struct<city:string,region:string,country:string,remote:boolean,hybrid:boolean,fullLocation:string>,department:string>>>"
RIPPLING = "array<struct<uuid:string,id:string,name:string,url:string,workLocation:string,department:string>>"
WORKDAY = "struct<jobPostings:array<struct<title:string,externalPath:string,bulletFields:array<string>,locationsText:string>>>"
PERSONIO = "struct<position:array<struct<id:string,name:string,office:string,department:string,createdAt:string>>>"
TEAMTAILOR = "struct<channel:struct<item:array<struct<title:string,link:string,description:string>>>>"
#: Placeholders that a page's own script would have translated.
BREEZY_LOCATIONS = (("%LABEL_MULTIPLE_LOCATIONS%", "Multiple locations"),)


def _postings(rows: DataFrame, ats: str, **fields: Column | str) -> DataFrame:
    values = {"company": F.col("company"), "ats": F.lit(ats), "raw": F.lit(None).cast("string")}
    values |= {k: F.lit(v) if isinstance(v, str) else text(v) for k, v in fields.items()}
    return rows.select(*(values.get(c, F.lit("")).alias(c) for c in POSTING))


def _each(rows: DataFrame, items: Column) -> DataFrame:
    return rows.select("company", "token", F.posexplode(items).alias("pos", "j"))


def _list(kind: str) -> Column:
    """The payload as a list; null where it is none, as a lone object would pass for a list of one."""
    return F.when(F.startswith(strip(F.col("payload")), F.lit("[")), F.from_json("payload", kind))


def _field(value: Column, path: str) -> Column:
    """A member of what may be a JSON object; "" where it is anything else."""
    return text(F.get_json_object(value, path))


def _parts(*values: Column) -> Column:
    return F.array_join(F.filter(F.array(*values), lambda x: text(x) != ""), ", ")


def work_type_from_metadata(metadata: Column) -> Column:
    """remote or hybrid, as the first metadata element with either in its name or text value says; remote first."""
    items = F.from_json(metadata, "array<struct<name:string,value:string>>")
    # A value that is no string comes back as JSON, which is not searched; only plain strings carry no marks of it.
    both = F.transform(items, lambda m: F.lower(F.concat_ws(" ", text(m["name"]), F.when(~text(m["value"]).rlike(r"^[\[{]"), m["value"]))))
    kinds = F.transform(both, lambda b: F.when(F.contains(b, F.lit("remote")), "remote").when(F.contains(b, F.lit("hybrid")), "hybrid"))
    return text(F.try_element_at(F.filter(kinds, lambda k: k.isNotNull()), F.lit(1)))


def greenhouse(rows: DataFrame) -> DataFrame:
    j = F.col("j")
    names = F.array_join(F.transform(j["departments"], lambda d: _field(d, "$.name")), " / ")
    return _postings(_each(rows, F.from_json("payload", GREENHOUSE)["jobs"]), "greenhouse", job_id=j["id"].cast("string"), title=j["title"], location=_field(j["location"], "$.name"), url=j["absolute_url"], department=names, work_type=work_type_from_metadata(j["metadata"]), posted_at=j["first_published"])


def lever(rows: DataFrame) -> DataFrame:
    j = F.col("j")
    return _postings(
        _each(rows, _list(LEVER)), "lever", job_id=j["id"], title=j["text"], location=_field(j["categories"], "$.location"), url=F.coalesce(known(j["applyUrl"]), j["hostedUrl"]), department=_field(j["categories"], "$.team"), work_type=F.lower(text(j["workplaceType"])), posted_at=iso_from_millis(j["createdAt"])
    )


def ashby(rows: DataFrame) -> DataFrame:
    """The page's own data: the first ``jobPostings`` at any depth; unlisted ones are left out."""
    j = F.col("j")
    found = rows.withColumn("_postings", json_first_key(assigned_json(F.col("payload"), "__appData"), "jobPostings"))
    listed = _each(found, F.from_json("_postings", ASHBY)).where(F.coalesce(j["isListed"], F.lit(True)))
    url = F.concat(F.lit("https://jobs.ashbyhq.com/"), F.col("token"), F.lit("/"), text(j["id"]))
    return _postings(listed, "ashby", job_id=j["id"], title=j["title"], location=F.coalesce(known(j["locationName"]), j["locationExternalName"]), url=url, department=F.coalesce(known(j["departmentName"]), j["departmentExternalName"]), work_type=F.lower(text(j["workplaceType"])), posted_at=j["publishedDate"])


def workable(rows: DataFrame) -> DataFrame:
    j, data = F.col("j"), F.from_json("payload", WORKABLE)
    items = F.when(F.size(F.coalesce(data["results"], F.array())) > 0, data["results"]).otherwise(data["jobs"])
    teams = F.from_json(j["department"], "array<string>")
    department = F.when(F.startswith(text(j["department"]), F.lit("[")), F.array_join(teams, " / ")).otherwise(j["department"])
    kind = F.coalesce(known(j["workplace"]), F.when(j["remote"], F.lit("remote")))
    url = F.concat(F.lit("https://apply.workable.com/"), F.col("token"), F.lit("/j/"), text(j["shortcode"]))
    return _postings(_each(rows, items), "workable", job_id=F.coalesce(known(j["shortcode"]), j["id"]), title=j["title"], location=_parts(j["location"]["city"], j["location"]["region"], j["location"]["country"]), url=url, department=department, work_type=F.lower(text(kind)), posted_at=j["published"])


def smartrecruiters(rows: DataFrame) -> DataFrame:
    j = F.col("j")
    place = j["location"]
    kind = F.when(place["remote"], "remote").when(place["hybrid"], "hybrid").otherwise("onsite")
    url = F.concat(F.lit("https://jobs.smartrecruiters.com/"), F.col("token"), F.lit("/"), text(j["id"]))
    return _postings(_each(rows, F.from_json("payload", SMARTRECRUITERS)["content"]), "smartrecruiters", job_id=j["id"], title=j["name"], location=F.coalesce(known(place["fullLocation"]), _parts(place["city"], place["region"], place["country"])), url=url, department=_field(j["department"], "$.label"), work_type=kind, posted_at=j["releasedDate"])


def personio(rows: DataFrame) -> DataFrame:
    j = F.col("j")
    url = F.concat(F.lit("https://"), F.col("token"), F.lit(".jobs.personio.com/job/"), strip(j["id"]), F.lit("?language=en"))
    return _postings(_each(rows, F.from_xml("payload", PERSONIO)["position"]), "personio", job_id=strip(j["id"]), title=strip(j["name"]), location=strip(j["office"]), url=url, department=strip(j["department"]), posted_at=strip(j["createdAt"]))


def _label(value: Column) -> Column:
    """The label of a JSON object, or what is there instead of one."""
    return F.when(F.startswith(text(value), F.lit("{")), _field(value, "$.label")).otherwise(value)


def rippling(rows: DataFrame) -> DataFrame:
    j = F.col("j")
    job_id = F.coalesce(known(j["uuid"]), j["id"])
    url = F.coalesce(known(j["url"]), F.concat(F.lit("https://ats.rippling.com/"), F.col("token"), F.lit("/jobs/"), text(job_id), F.lit("/apply?step=application")))
    return _postings(_each(rows, _list(RIPPLING)), "rippling", job_id=job_id, title=j["name"], location=_label(j["workLocation"]), url=url, department=_label(j["department"]))


def teamtailor(rows: DataFrame) -> DataFrame:
    j = F.col("j")
    link, about = strip(j["link"]), strip(j["description"])
    span = lambda name: strip(strip_tags(F.regexp_extract(about, rf'(?i)<span[^>]*class="[^"]*{name}[^"]*"[^>]*>(.*?)</span>', 1)))
    job_id = F.when(F.contains(link, F.lit("/jobs/")), F.substring_index(F.substring_index(link, "/jobs/", -1), "?", 1)).otherwise("")
    return _postings(_each(rows, F.from_xml("payload", TEAMTAILOR)["channel"]["item"]), "teamtailor", job_id=job_id, title=strip(j["title"]), location=span("location"), url=link, department=span("department"))


def _first_cards(cards: DataFrame) -> DataFrame:
    """A board's first card of each id."""
    return first_per_key(cards, ["company", "token", "job_id"], ["pos"])


def breezyhr(rows: DataFrame) -> DataFrame:
    card = r'(?s)<a\s+href="(/p/[A-Za-z0-9_-]+)"[^>]*>(.*?)</a>'
    each = rows.select("company", "token", F.posexplode(F.arrays_zip(F.regexp_extract_all("payload", F.lit(card), F.lit(1)).alias("href"), F.regexp_extract_all("payload", F.lit(card), F.lit(2)).alias("body"))).alias("pos", "j"))
    each = each.select("company", "token", "pos", "j.href", "j.body").where(F.contains("body", F.lit("<h2")))
    slug = F.substring(F.col("href"), F.lit(4), F.length("href"))
    each = _first_cards(each.withColumn("job_id", F.coalesce(known(F.regexp_extract(slug, "^[0-9a-f]+", 0)), slug)))
    part = lambda pattern: clean(F.regexp_extract("body", pattern, 1))
    place = part(r'(?s)class="location"[^>]*>.*?<span[^>]*>(.*?)</span>')
    for mark, name in BREEZY_LOCATIONS:
        place = F.when(place == mark, name).otherwise(place)
    kind = part(r'(?s)class="type"[^>]*>.*?<span[^>]*>(.*?)</span>')
    mark = F.regexp_extract(kind, "^%LABEL_POSITION_TYPE_([A-Z_]+)%", 1)
    kind = F.lower(F.when(mark != "", F.replace(mark, F.lit("_"), F.lit(" "))).otherwise(kind))
    url = F.concat(F.lit("https://"), F.col("token"), F.lit(".breezy.hr"), F.col("href"))
    return _postings(each, "breezyhr", job_id=F.col("job_id"), title=part("(?s)<h2[^>]*>(.*?)</h2>"), location=place, url=url, work_type=kind)


def onlyfy(rows: DataFrame) -> DataFrame:
    card = r'(?s)<a\b([^>]*data-testid="job-card"[^>]*)>(.*?)</a>'
    each = rows.select("company", "token", F.posexplode(F.arrays_zip(F.regexp_extract_all("payload", F.lit(card), F.lit(1)).alias("attrs"), F.regexp_extract_all("payload", F.lit(card), F.lit(2)).alias("body"))).alias("pos", "j"))
    each = each.select("company", "token", "pos", "j.attrs", "j.body", F.regexp_extract("j.attrs", r'href="(/[a-z]{2}/job/[A-Za-z0-9]+)"', 1).alias("href")).where("href <> ''")
    each = _first_cards(each.withColumn("job_id", F.substring_index("href", "/", -1)))
    title = F.coalesce(known(clean(F.regexp_extract("body", r'(?s)data-testid="job-title"[^>]*>(.*?)</h3>', 1))), unescape(F.regexp_extract("attrs", r'aria-label="([^"]*)"', 1)))
    info = F.split(unescape(F.regexp_extract("body", r'(?s)data-testid="job-more-info"[^>]*>(.*?)</div>', 1)), r"\|")
    at = lambda n: one_line(strip_tags(F.try_element_at(info, F.lit(n))))
    url = F.concat(F.lit("https://"), F.col("token"), F.lit(".onlyfy.jobs"), F.col("href"))
    return _postings(each, "onlyfy", job_id=F.col("job_id"), title=title, location=at(1), url=url, department=at(4), work_type=at(2), posted_at=iso_from_dotted(at(3)))


def mailto(rows: DataFrame) -> DataFrame:
    """Roles offered as mail links: the subject names the role; the page states no place, so it is the profile's."""
    hrefs = F.array_distinct(F.regexp_extract_all("payload", F.lit(r'(?i)href="(mailto:[^"]+)"'), F.lit(1)))
    each = rows.select("company", "token", F.posexplode(hrefs).alias("pos", "href")).withColumn("href", unescape(F.col("href")))
    subject = F.try_url_decode(F.regexp_extract("href", r"[?&]subject=([^&]*)", 1))
    title = strip(F.regexp_replace(text(subject), r"(?i)^\s*application\s*[—\-]\s*", ""))
    each = each.withColumn("title", title).where("title <> ''").withColumn("job_id", F.lower("title"))
    each = _first_cards(each)
    slug = F.regexp_replace(F.regexp_replace(F.lower("title"), "[^a-z0-9]+", "-"), "^-+|-+$", "")
    return _postings(each, "mailto", job_id=F.coalesce(known(slug), "title"), title=F.col("title"), location="Remote, India", url=F.col("href"), work_type="remote")


def workday(rows: DataFrame) -> DataFrame:
    """Pages of results; the token is the careers address."""
    j, base = F.col("j"), F.regexp_extract("token", r"^(https?://[^/]+)", 1)
    place, path = text(j["locationsText"]), text(j["externalPath"])
    kind = F.when(F.contains(F.lower(place), F.lit("remote")), "remote").when(F.contains(F.lower(place), F.lit("hybrid")), "hybrid").otherwise("")
    url = F.when(path != "", F.concat(base, path)).otherwise(F.col("token"))
    return _postings(_each(rows, F.from_json("payload", WORKDAY)["jobPostings"]), "workday", job_id=F.coalesce(known(F.try_element_at(j["bulletFields"], F.lit(1))), path), title=j["title"], location=place, url=url, work_type=kind)


#: Parsers by source.
PARSERS: dict[str, Callable[[DataFrame], DataFrame]] = {f.__name__: f for f in (greenhouse, lever, ashby, workable, smartrecruiters, personio, rippling, teamtailor, breezyhr, onlyfy, mailto, workday)}


def parse(fetched: DataFrame) -> DataFrame:
    """``(company, ats, token, payload)`` of any sources -> postings; each source's rows go to its parser."""
    out = None
    for ats, parser in PARSERS.items():
        part = parser(fetched.where(F.col("ats") == ats).select("company", "token", "payload"))
        out = part if out is None else out.unionByName(part)
    return out


def payload_error(ats: Column, payload: Column) -> Column:
    """Why a payload is no listing of its source; null where it is one."""
    p = strip(payload)
    lists = ats.isin("lever", "rippling") & ~F.startswith(p, F.lit("["))
    cards = ((ats == "breezyhr") & ~F.contains(p, F.lit("/p/"))) | ((ats == "onlyfy") & ~F.contains(p, F.lit("/job/")))
    return F.when(p == "", "empty response").when(lists, "unexpected response").when(cards, "no job links in HTML").when((ats == "ashby") & ~F.contains(p, F.lit("__appData")), "no embedded data")
