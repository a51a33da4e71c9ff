"""URL and host functions on columns; registrable domains by an equi-join with a suffix table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Hosting platforms whose registrable domain says nothing about a campaign.
SHARED_PLATFORMS = [
    "github.io", "blogspot.com", "wixsite.com", "weebly.com", "firebaseapp.com", "web.app", "netlify.app", "vercel.app", "pages.dev",
    "herokuapp.com", "azurewebsites.net", "windows.net", "googleapis.com", "appspot.com", "000webhostapp.com", "glitch.me", "repl.co",
    "square.site", "godaddysites.com", "webflow.io", "framer.app", "filesusr.com", "sharepoint.com", "ipfs.io", "r2.dev", "workers.dev",
    "duckdns.org", "ngrok.io", "ngrok-free.app",
]
# Words that name no entity in a url, and the pattern of urls in texts.
GENERIC_WORDS = """
www com net org gov edu info biz html htm php asp aspx jsp index home page pages login
signin sign account accounts secure security update verify verification auth web site
online app apps api mail email support service services help user users id www2 static
cdn img images assets files file download public http https main default portal
the and for are not was but its has had can you our who why how all any new now use
get set one two see what when where your with from this that into about more most news
blog post posts article articles category tag tags search view item items product
products shop store en us uk de fr es jp
""".split()
URL = r"https?://[^\s<>\"')]+"


def host_of(url: Column) -> Column:
    """URL1: lower-case host without port, user and trailing dots; empty where there is none."""
    host = F.regexp_extract(url, r"^\s*[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)
    return F.coalesce(F.regexp_replace(F.lower(host), r"\.+$", ""), F.lit(""))


def normalize_url(url: Column) -> Column:
    """URL2: lower scheme and host, no default port, fragment or trailing slashes; the query stays."""
    u = F.trim(url)
    scheme = F.lower(F.regexp_extract(u, r"^([a-zA-Z][a-zA-Z0-9+.-]*)://", 1))
    port = F.regexp_extract(u, r"^[^/]*//[^/?#:]*:([0-9]+)", 1)
    path = F.regexp_replace(F.regexp_extract(u, r"^[^/]*//[^/?#]*([^?#]*)", 1), r"/+$", "")
    query = F.regexp_extract(u, r"^[^?#]*(\?[^#]*)", 1)
    keep = F.when((port == "") | port.isin("80", "443"), "").otherwise(F.concat(F.lit(":"), port))
    whole = F.concat(scheme, F.lit("://"), host_of(u), keep, F.when(path == "", "/").otherwise(path), query)
    return F.when(scheme == "", F.lower(u)).otherwise(whole)


def host_suffixes(host: Column) -> Column:
    """The host and its parents, longest first."""
    labels = F.split(host, r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))


def registrable(df: DataFrame, host: str, suffixes: DataFrame, out: str = "registrable") -> DataFrame:
    """URL3: the longest public suffix and one label more, by an equi-join of the hosts' parents with the table of suffixes
    (``suffix``). A host under no suffix, or that is one, stands for itself; so does an address of digits."""
    hosts = df.select(F.col(host).alias("_h")).distinct()
    keyed = hosts.select("_h", F.posexplode(host_suffixes(F.col("_h"))).alias("_i", "_s"))
    best = keyed.join(suffixes.select(F.col("suffix").alias("_s")).distinct(), "_s").groupBy("_h").agg(F.min("_i").alias("_i"))
    reg = F.when((F.col("_i") > 0) & ~F.col("_h").rlike(r"^[0-9.]+$"), F.element_at(host_suffixes(F.col("_h")), F.col("_i")))
    named = best.where("_i > 0").select("_h", reg.alias("_r"))
    return df.join(named, F.col(host) == F.col("_h"), "left").withColumn(out, F.coalesce("_r", F.col(host))).drop("_h", "_r")


def platform_suffix(df: DataFrame, host: str, private: DataFrame, out: str = "platform") -> DataFrame:
    """URL4: the longest private suffix (``suffix``) that a host lies under, or is; null where there is none."""
    hosts = df.select(F.col(host).alias("_h")).distinct()
    keyed = hosts.select("_h", F.explode(host_suffixes(F.col("_h"))).alias("suffix"))
    best = keyed.join(private.select("suffix").distinct(), "suffix").groupBy("_h").agg(F.max_by("suffix", F.length("suffix")).alias(out))
    return df.join(best, F.col(host) == F.col("_h"), "left").drop("_h")


def site_key(host: Column, reg: Column) -> Column:
    """URL5: the host on shared platforms, else the registrable domain."""
    return F.when(reg.isin(SHARED_PLATFORMS), host).otherwise(reg)


def url_tokens(url: Column, reg: Column) -> Column:
    """URL6: words of the subdomain and the path, 3 letters or more, neither digits nor generic; sorted and distinct."""
    host = host_of(url)
    sub = F.when(host.endswith(F.concat(F.lit("."), reg)), F.substring(host, F.lit(1), F.length(host) - F.length(reg) - 1)).otherwise("")
    path = F.regexp_extract(url, r"^[^/]*//[^/?#]*([^?#]*)", 1)
    words = F.split(F.lower(F.concat_ws(" ", sub, path)), r"[^a-z0-9]+")
    keep = F.filter(words, lambda w: (F.length(w) >= 3) & ~w.rlike(r"^[0-9]+$"))
    return F.array_sort(F.array_distinct(F.array_except(keep, F.array(*map(F.lit, GENERIC_WORDS)))))


def lexical_features(url: Column) -> dict[str, Column]:
    """URL7: length, digits, dots in the host, address host, at sign, punycode."""
    host = host_of(url)
    return {
        "log_length": F.log1p(F.length(url).cast("double")),
        "digits": F.regexp_count(url, F.lit("[0-9]")).cast("long"),
        "host_dots": F.regexp_count(host, F.lit(r"\.")).cast("long"),
        "is_address": host.rlike(r"^[0-9.]+$"),
        "has_at": url.contains("@"),
        "punycode": host.contains("xn--"),
    }


def destination(link: Column, page_site: Column, link_site: Column) -> Column:
    """URL8: null, mailto, same or external destination of a link."""
    bare = F.trim(F.lower(link))
    empty = (bare == "") | bare.startswith("#") | bare.startswith("javascript:")
    inside = ~bare.rlike(r"^(?:[a-z][a-z0-9+.-]*:)?//")
    return F.when(empty, "null").when(bare.startswith("mailto:"), "mailto").when(inside | (page_site == link_site), "same").otherwise("external")


def link_host(link: Column, page: Column) -> Column:
    """Host of a link on a page: its own if it names one, the page's if it is relative, empty for mailto and the like."""
    bare = F.trim(link)
    return (
        F.when(bare.rlike(r"^[a-zA-Z][a-zA-Z0-9+.-]*://"), host_of(bare))
        .when(bare.startswith("//"), host_of(F.concat(F.lit("http:"), bare)))
        .when(bare.rlike(r"^[a-zA-Z][a-zA-Z0-9+.-]*:"), F.lit(""))
        .otherwise(host_of(page))
    )


def extract_urls(text: Column) -> Column:
    """URL9: all urls of a text in order."""
    return F.regexp_extract_all(text, F.lit(URL), F.lit(0))


def covering_names(host: Column) -> Column:
    """URL11: the certificate names that can cover a host, each with its kind: its own, and from three labels up the wildcard of its
    parent (of one label only; below that the parent is a public suffix)."""
    bare = F.regexp_replace(F.lower(host), r"\.+$", "")
    exact = F.struct(bare.alias("name"), F.lit("exact").alias("covers"))
    wide = F.struct(F.concat(F.lit("*."), F.regexp_replace(bare, r"^[^.]*\.", "")).alias("name"), F.lit("wildcard").alias("covers"))
    return F.when(F.size(F.split(bare, r"\.")) >= 3, F.array(exact, wide)).otherwise(F.array(exact))


def cover_kind(host: Column, name: Column) -> Column:
    """URL11: how a certificate name covers a host: exact, wildcard, or null."""
    clean = F.trim(F.lower(name))
    return F.try_element_at(F.filter(covering_names(host), lambda n: n["name"] == clean), F.lit(1))["covers"]


def certificate_scope(host: Column, name: Column, platform: Column) -> Column:
    """URL12: host, platform_wildcard or own_wildcard."""
    kind = cover_kind(host, name)
    return F.when(kind == "exact", "host").when((kind == "wildcard") & (name == F.concat(F.lit("*."), platform)), "platform_wildcard").when(kind == "wildcard", "own_wildcard")
