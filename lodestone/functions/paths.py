"""Package paths as column expressions: owner, project, host and friends."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Hosts whose second or third path part names the project, and hosts with a fixed owner or project.
TWO_PART_HOSTS = ["llamaslayers.net", "bazil.org"]
THREE_PART_HOSTS = ["github.com", "code.google.com", "bitbucket.org", "labix.org"]
OWNER_HOSTS = ["github.com", "bitbucket.org"]
FIXED_OWNER = {"llamaslayers.net": "Nightgunner5"}
FIXED_PROJECT = {"golanger.com": "golangers", "cgl.tideland.biz": "tcgl"}
VERSIONED_HOST = "gopkg.in"
TILDE_HOST = "launchpad.net"


def _part(pkg: Column, i: int) -> Column:
    return F.get(F.split(pkg, "/"), i)


def _parts(pkg: Column) -> Column:
    return F.size(F.split(pkg, "/"))


def _unversioned(part: Column) -> Column:
    """What stands before the last ``.v``; empty if there is none or nothing before it."""
    return F.regexp_extract(part, r"^(.+)\.v", 1)


def author(pkg: Column) -> Column:
    """Owner of a package; the first path part where the host has no owners."""
    host, second = _part(pkg, 0), _part(pkg, 1)
    out = F.when(host.isin(OWNER_HOSTS) & second.isNotNull(), second)
    for name, owner in FIXED_OWNER.items():
        out = out.when(host == name, F.lit(owner))
    out = out.when((host == TILDE_HOST) & second.startswith("~"), F.substring(second, 2, 1 << 30))
    own = _unversioned(second)
    out = out.when((host == VERSIONED_HOST) & (_parts(pkg) == 2), F.when(own == "", host).otherwise(F.concat(F.lit("go-"), own)))
    return out.when((host == VERSIONED_HOST) & (_parts(pkg) > 2), second).otherwise(host)


def project(pkg: Column) -> Column:
    """Short project name; the whole path where no host rule holds."""
    host, second, third = _part(pkg, 0), _part(pkg, 1), _part(pkg, 2)
    out = F.when(host.isin(TWO_PART_HOSTS) & second.isNotNull(), second).when(host.isin(THREE_PART_HOSTS) & third.isNotNull(), third)
    for name, fixed in FIXED_PROJECT.items():
        out = out.when(host == name, F.lit(fixed))
    out = out.when((host == TILDE_HOST) & second.startswith("~") & third.isNotNull(), third).when((host == TILDE_HOST) & second.isNotNull(), second)
    own = _unversioned(F.coalesce(third, second))
    return out.when((host == VERSIONED_HOST) & second.isNotNull(), F.when(own == "", host).otherwise(own)).otherwise(pkg)


def first_parts(pkg: Column, n: int) -> Column:
    return F.array_join(F.slice(F.split(pkg, "/"), 1, n), "/")


def full_project(pkg: Column) -> Column:
    """The leading path that identifies the project."""
    host = _part(pkg, 0)
    out = F.when(host.isin(*TWO_PART_HOSTS, TILDE_HOST), first_parts(pkg, 2))
    for name, fixed in FIXED_PROJECT.items():
        out = out.when(host == name, F.lit(f"{name}/{fixed}"))
    return out.otherwise(first_parts(pkg, 3))


def host(pkg: Column) -> Column:
    """Host (with port) of ``http://pkg``; empty if it can't be one."""
    found = F.regexp_extract(pkg, r"^[^/?#]*", 0)
    return F.when(found.contains(" "), F.lit("")).otherwise(found)


def site(pkg: Column) -> Column:
    return F.get(F.split(pkg, "/", 2), 0)


def rest(pkg: Column) -> Column:
    return F.coalesce(F.get(F.split(pkg, "/", 2), 1), F.lit(""))


def person_id(site_: Column, name: Column) -> Column:
    return F.concat_ws(":", site_, name)


def person_parts(id_: Column) -> tuple[Column, Column]:
    parts = F.split(id_, ":")
    return F.coalesce(F.get(parts, 0), F.lit("")), F.coalesce(F.get(parts, 1), F.lit(""))


def remove_host(pkg: Column) -> Column:
    return F.regexp_replace(pkg, r"^[^/]+/(?=.)", "")


def display_name(name: Column, pkg: Column) -> Column:
    own = project(pkg)
    return F.when(name == "", F.concat(F.lit("("), own, F.lit(")"))).when(name == "main", F.concat(F.lit("main - "), own)).otherwise(name)


def partition_hash(pkg: Column, parts: int = 128) -> Column:
    """h = 33 h + byte, reduced only when above ``parts``, so that ``parts`` itself can come out."""
    codes = F.transform(F.filter(F.split(F.hex(F.encode(pkg, "UTF-8")), "(?<=\\G..)"), lambda x: x != ""), lambda x: F.conv(x, 16, 10).cast("long"))

    def step(h: Column, b: Column) -> Column:
        now = h * 33 + b
        return F.when(now > parts, now % parts).otherwise(now)

    return F.aggregate(codes, F.lit(0).cast("long"), step)


def ancestors(pkg: Column, least: int = 2) -> Column:
    """Proper prefixes of at least ``least`` parts, shortest first."""
    parts = F.split(pkg, "/")
    return F.when(F.size(parts) > least, F.transform(F.sequence(F.lit(least), F.greatest(F.size(parts) - 1, F.lit(least))), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))).otherwise(F.array().cast("array<string>"))


def full_path(user: Column, repo: Column, path: Column, name: Column) -> Column:
    """user/repo/path/name with single slashes."""
    joined = F.concat_ws("/", user, repo, F.when(path == "", None).otherwise(path), name)
    return F.regexp_replace(joined, "/{2,}", "/")


def trim_name(pkg: Column) -> Column:
    """Without outer white space and outer non-ASCII characters."""
    return F.regexp_replace(F.regexp_replace(pkg, r"^\s+|\s+$", ""), r"^[^\x00-\x80]+|[^\x00-\x80]+$", "")


def valid_remote(pkg: Column) -> Column:
    """The first part has a dot, and no part is empty or has white space."""
    return pkg.rlike(r"^[^/\s]*[^/\s.]\.[^/\s.][^/\s]*(?:/[^/\s]+)*$")


def readable_size(n: Column) -> Column:
    """Powers of 1024 with one to three digits of meaning."""
    out = None
    for power, unit in enumerate(("", "K", "M", "G", "T", "P")):
        base = 1024**power
        whole = F.floor(n / F.lit(base))
        value = n.cast("double") / F.lit(float(base))
        text = F.when(whole < 10, F.concat(F.format_string("%.2f", value), F.lit(unit))).when(whole < 100, F.concat(F.format_string("%.1f", value), F.lit(unit))).otherwise(F.concat(whole.cast("string"), F.lit(unit)))
        out = F.when(n < base * 1024, text) if out is None else out.when(n < base * 1024, text) if unit != "P" else out.otherwise(text)
    return out


def readable_duration(seconds: Column) -> Column:
    """The largest fitting unit from days to nanoseconds, of a duration in seconds."""
    nanos = F.round(seconds * 1_000_000_000).cast("long")
    count = lambda per: F.format_string("%.0f", seconds / F.lit(float(per)))
    return (
        F.when(seconds > 86400, F.concat(count(86400), F.lit(" days"))).when(seconds >= 3600, F.concat(count(3600), F.lit(" hours"))).when(seconds >= 60, F.concat(count(60), F.lit(" mins")))
        .when(seconds >= 1, F.concat(count(1), F.lit(" sec"))).when(nanos >= 1_000_000, F.concat(F.floor(nanos / 1_000_000).cast("string"), F.lit(" ms")))
        .when(nanos >= 1000, F.concat(F.floor(nanos / 1000).cast("string"), F.lit(" us"))).otherwise(F.concat(nanos.cast("string"), F.lit(" ns")))
    )


def callback_name(name: Column) -> Column:
    return F.regexp_replace(name, r"[^A-Za-z0-9_$]", "")


def jsonp(callback: Column, code: Column, body: Column) -> Column:
    own = callback_name(callback)
    return F.when(own == "", body).otherwise(F.concat(own, F.lit("("), code.cast("string"), F.lit(", "), body, F.lit(");")))
