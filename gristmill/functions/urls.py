"""URL functions on columns."""

from __future__ import annotations

from ipaddress import ip_network

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import fold, let

# Hosts whose links only count clicks.
TRACKERS = ("simplify.jobs", "click.appcast.io", "trk.simplify.jobs", "jobright.ai", "app.otta.com", "get.hiring.cafe", "grnh.se", "boards.greenhouse.io.simplify.jobs", "l.workwithus.io", "track.rippling-ats.com")
# Languages that lead a path.
LANGUAGES = ("ar", "cs", "da", "de", "el", "en", "es", "fi", "fr", "he", "hu", "ja", "ko", "nl", "pl", "pt", "ro", "ru", "sv", "th", "tr", "vi", "zh")
# Boards that a path names on a host of their platform: platform, hosts, the segments that may stand
# before the name (those of "needs" must), and what a name may hold: "plain" as in a host, "dotted" dots too, "cased"
# capitals too.
PATH_BOARDS = (
    {"platform": "greenhouse", "hosts": ("boards.greenhouse.io", "job-boards.greenhouse.io", "boards.eu.greenhouse.io", "job-boards.eu.greenhouse.io", "boards-api.greenhouse.io", "api.greenhouse.io"), "before": (("v1", "boards"),), "locale": True, "name": "plain"},
    {"platform": "lever", "hosts": ("jobs.lever.co", "api.lever.co", "jobs.eu.lever.co"), "before": (("v0", "postings"),), "name": "cased"},
    {"platform": "ashby", "hosts": ("jobs.ashbyhq.com", "api.ashbyhq.com"), "before": (("posting-api", "job-board"),), "name": "dotted"},
    {"platform": "smartrecruiters", "hosts": ("careers.smartrecruiters.com", "jobs.smartrecruiters.com", "api.smartrecruiters.com"), "before": (("v1", "companies"),), "name": "plain"},
    {"platform": "workable", "hosts": ("apply.workable.com",), "name": "plain"},
    {"platform": "jobvite", "hosts": ("jobs.jobvite.com",), "name": "plain"},
    {"platform": "join", "hosts": ("join.com", "www.join.com"), "needs": (("companies",),), "name": "plain"},
    {"platform": "collage", "hosts": ("secure.collage.co", "api.collage.co"), "needs": (("jobs",), ("v1", "positions")), "name": "plain"},
)
# Boards that one label of a host names: platform, what stands before the label and after it.
HOST_BOARDS = (
    ("bamboohr", "", ".bamboohr.com"),
    ("recruitee", "", ".recruitee.com"),
    ("breezy", "", ".breezy.hr"),
    ("teamtailor", "", ".teamtailor.com"),
    ("workable", "", ".workable.com"),
    ("personio", "", ".jobs.personio.de"),
    ("personio", "", ".jobs.personio.com"),
    ("taleo", "", ".taleo.net"),
    ("icims", "careers-", ".icims.com"),
    ("njoyn", "", ".njoyn.com"),
    ("eightfold", "", ".eightfold.ai"),
    ("cornerstone", "", ".csod.com"),
)
# Path segments that are no board's name.
RESERVED = ("jobs", "job", "careers", "search", "embed", "api", "v1")
# First labels of a careers host.
CAREERS = ("emploi", "emplois", "career", "careers", "carriere", "carrieres", "job", "jobs", "recruiting", "recrutement", "talent", "www")
# Ranges of addresses that are not public, and those within them that are.
NOT_PUBLIC = (
    "0.0.0.0/8", "10.0.0.0/8", "100.64.0.0/10", "127.0.0.0/8", "169.254.0.0/16", "172.16.0.0/12", "192.0.0.0/24", "192.0.2.0/24", "192.168.0.0/16", "198.18.0.0/15", "198.51.100.0/24", "203.0.113.0/24", "240.0.0.0/4",
    "::/128", "::1/128", "::ffff:0:0/96", "64:ff9b:1::/48", "100::/64", "2001::/23", "2001:db8::/32", "2002::/16", "3fff::/20", "fc00::/7", "fe80::/10",
)
PUBLIC_WITHIN = ("192.0.0.9/32", "192.0.0.10/32", "2001:1::1/128", "2001:1::2/128", "2001:3::/32", "2001:4:112::/48", "2001:20::/28", "2001:30::/28")
_PARTS = r"^([A-Za-z][A-Za-z0-9+.-]*)://(?:[^/?#@]*@)?([^/?#:]*)(?::\d*)?([^?#]*)"
_DIGITS, _SMALL, _CAPITALS = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def _is_name(s: Column, extra: str = "-", most: int = 63, cased: bool = False) -> Column:
    """True for 1 to ``most`` letters, digits and characters of ``extra`` that begin with a letter or digit; where dots
    may lie within, they and hyphens may not end it. Capitals count only where ``cased``."""
    own = _SMALL + _DIGITS + (_CAPITALS if cased else "")
    at_ends = F.translate(F.substring(s, 1, 1), own, "") == ""
    if "." in extra:
        at_ends = at_ends & (F.translate(F.right(s, F.lit(1)), own, "") == "")
    return (F.length(s) > 0) & (F.length(s) <= most) & (F.translate(s, own + extra, "") == "") & at_ends


_NAMES = {"plain": {}, "dotted": {"extra": "-."}, "cased": {"cased": True}}


def _is_locale(segment: Column) -> Column:
    """``fr`` or ``fr-CA``."""
    parts = F.split(segment, "-")
    two = lambda x, letters: (F.length(x) == 2) & (F.translate(x, letters, "") == "")
    return two(parts[0], _SMALL) & ((F.size(parts) == 1) | ((F.size(parts) == 2) & two(F.get(parts, F.lit(1)), _SMALL + _CAPITALS)))


def scheme(url: Column) -> Column:
    return F.lower(F.regexp_extract(F.trim(url), _PARTS, 1))


def host(url: Column) -> Column:
    return F.lower(F.regexp_extract(F.trim(url), _PARTS, 2))


def is_tracker(url: Column) -> Column:
    h = host(url)
    return F.exists(F.array(*[F.lit(t) for t in TRACKERS]), lambda t: (h == t) | h.endswith(F.concat(F.lit("."), t)))


def canonical_apply_url(url: Column) -> Column:
    """https, lower-case host, no port, query or fragment, no locale segments, no trailing slash; '' for other
    schemes and for links that only count clicks."""
    locale = F.array(*[F.lit(x) for x in LANGUAGES])
    kept = F.filter(F.split(F.regexp_extract(F.trim(url), _PARTS, 3), "/"), lambda s: (s != "") & ~(s.rlike("^[a-z]{2}[-_][a-zA-Z]{2}$") | F.array_contains(locale, F.lower(s))))
    plain = F.concat(F.lit("https://"), host(url), F.lit("/"), F.array_join(kept, "/"))
    return F.when(scheme(url).isin("http", "https") & (host(url) != "") & ~is_tracker(url), plain).otherwise("")


def web_url(url: Column) -> Column:
    return F.when(scheme(url).isin("http", "https") & (host(url) != ""), F.trim(url)).otherwise("")


def _authority(url: Column) -> Column:
    """Host of a URL, with an address in brackets without them; no zone, no dots at the end, lower case."""
    held = F.regexp_extract(F.trim(url), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?(\[[^/?#\]]*\]|[^/?#:]*)", 1)
    bare = F.regexp_replace(F.translate(held, "[]", ""), "%.*$", "")
    return F.lower(F.regexp_replace(bare, r"\.+$", ""))


def _number(label: Column) -> Column:
    """A part of an address in decimal, octal (leading 0) or hex (0x), or null."""
    small = F.length(label) <= 12
    return (
        F.when(small & label.rlike("^0x[0-9a-f]+$"), F.conv(F.substring(label, 3, 12), 16, 10).cast("long"))
        .when(small & label.rlike("^0[0-7]*$"), F.conv(label, 8, 10).cast("long"))
        .when(small & label.rlike("^[1-9][0-9]*$"), label.cast("long"))
    )


def _v4(host_: Column) -> Column:
    """An IPv4 address as eight hex digits, or null: up to four numbers, of which the last fills the bytes that are left."""

    def joined(ns):
        n = F.size(ns)
        head, last = F.slice(ns, 1, n - 1), F.get(ns, n - 1)
        sound = (n <= 4) & ~F.exists(ns, lambda x: x.isNull()) & ~F.exists(head, lambda x: x > 255) & (last < F.pow(F.lit(256.0), 5 - n))
        high = F.aggregate(head, F.lit(0).cast("long"), lambda acc, x: acc * 256 + x)
        value = high * F.pow(F.lit(256.0), 5 - n).cast("long") + last
        return F.when(sound, F.lower(F.lpad(F.hex(value), 8, "0")))

    return let(F.transform(F.split(host_, r"\."), _number), joined)


def _v6(host_: Column) -> Column:
    """An IPv6 address as 32 hex digits, or null: groups, one run of zeros as ``::``, the last four bytes maybe as IPv4."""
    tail = F.regexp_extract(host_, r"([0-9]+\.[0-9]+\.[0-9]+\.[0-9]+)$", 1)
    low = _v4(tail)
    spelled = F.when(tail == "", host_).when(low.isNotNull(), F.concat(F.left(host_, F.length(host_) - F.length(tail)), F.left(low, F.lit(4)), F.lit(":"), F.right(low, F.lit(4))))
    groups = lambda x: F.when(x == "", F.array().cast("array<string>")).otherwise(F.split(x, ":"))

    def of(halves):
        left, right = groups(halves[0]), F.when(F.size(halves) > 1, groups(F.get(halves, F.lit(1)))).otherwise(F.array().cast("array<string>"))
        missing = 8 - F.size(left) - F.size(right)
        every = F.concat(left, F.array_repeat(F.lit("0"), F.greatest(missing, F.lit(0))), right)
        sound = ((F.size(halves) == 1) & (missing == 0) | (F.size(halves) == 2) & (missing >= 1)) & ~F.exists(every, lambda g: ~g.rlike("^[0-9a-f]{1,4}$"))
        return F.when(sound, F.array_join(F.transform(every, lambda g: F.lpad(g, 4, "0")), ""))

    return F.when(host_.contains(":"), let(F.split(spelled, "::"), of))


def _ranges() -> list[tuple[str, str, bool]]:
    """(first, last, public) of the special ranges, in order, addresses as hex digits behind a 4 or a 6."""
    out = []
    for public, nets in ((False, NOT_PUBLIC), (True, PUBLIC_WITHIN)):
        for net in map(ip_network, nets):
            first, last = (f"{net.version}{int(a):0{net.max_prefixlen // 4}x}" for a in (net[0], net[-1]))
            out.append((first, last, public))
    return sorted(out)


def is_public_address(digits: Column) -> Column:
    """True for an address, a 4 or 6 and its hex digits, that no special range holds, or a public one within."""
    table = F.array(*[F.struct(F.lit(a).alias("first"), F.lit(b).alias("last"), F.lit(p).alias("public")) for a, b, p in _ranges()])
    return let(digits, lambda x: F.coalesce(F.array_max(F.filter(table, lambda r: (r["first"] <= x) & (x <= r["last"])))["public"], F.lit(True)))


def public_https_url(url: Column) -> Column:
    """True for https without credentials, spaces and control characters, to a named host other than localhost or to
    a public address in whatever spelling: dotted, short, decimal, octal, hex, IPv6."""

    def judged(x):
        mapped = F.when(x["v6"].startswith("0" * 20 + "ffff"), F.concat(F.lit("4"), F.right(x["v6"], F.lit(8))))
        digits = F.coalesce(mapped, F.concat(F.lit("6"), x["v6"]), F.concat(F.lit("4"), x["v4"]))
        named = (x["h"] != "") & (x["h"] != "localhost") & ~x["h"].endswith(".localhost")
        return F.when(digits.isNotNull(), is_public_address(digits)).otherwise(named)

    whole = (scheme(url) == "https") & ~url.rlike("^[^/]*//[^/?#]*@") & ~F.trim(url).rlike(r"[\x00-\x20\x7F-\x9F]")
    facts = let(_authority(url), lambda h: F.struct(h.alias("h"), _v4(h).alias("v4"), _v6(h).alias("v6")))
    return whole & let(facts, judged)


def safe_slug(slug: Column, form: str = "plain") -> Column:
    """True for a name that may go into a host (``plain``) or a path (``dotted``, ``cased``)."""
    return _is_name(F.trim(slug) if form == "cased" else F.lower(F.trim(slug)), **_NAMES[form])


def _is_site(s: Column) -> Column:
    return _is_name(s, "_-", 64, cased=True)


def workday_target(tenant: Column, site: Column, dc: Column) -> Column:
    """struct(host, path) of a board's listing, null where a part is missing or of a wrong form."""
    t, d, s = F.lower(F.trim(tenant)), F.lower(F.trim(dc)), F.trim(site)
    ok = _is_name(t) & _is_centre(d) & _is_site(s)
    return F.when(ok, F.struct(F.concat(t, F.lit("."), d, F.lit(".myworkdayjobs.com")).alias("host"), F.concat(F.lit("/wday/cxs/"), t, F.lit("/"), s, F.lit("/jobs")).alias("path")))


def _is_centre(label: Column) -> Column:
    """``wd`` and a number of up to three digits."""
    return label.startswith("wd") & F.length(label).between(3, 5) & (F.translate(F.substring(label, 3, 9), _DIGITS, "") == "")


def oracle_target(host_: Column, site: Column) -> Column:
    """struct(host, site), null unless the host is two names or more that end in letters."""
    h, s = F.lower(F.trim(host_)), F.trim(site)
    labels = F.split(h, r"\.")
    last = F.get(labels, F.size(labels) - 1)
    sound = (F.size(labels) > 1) & F.forall(labels, lambda x: _is_name(x)) & F.length(last).between(2, 24) & (F.translate(last, _SMALL, "") == "")
    return F.when(sound & _is_site(s), F.struct(h.alias("host"), s.alias("site")))


def _vanity(host_: Column) -> Column:
    """The employer's label of a host: the first that is no careers word, if another follows it."""
    careers = F.array(*[F.lit(x) for x in CAREERS])

    def own(labels):
        first = F.array_position(F.transform(labels, lambda x: F.array_contains(careers, x)), False).cast("int")
        label = F.get(labels, first - 1)
        return F.when((first > 0) & (first < F.size(labels)) & _is_name(label), label)

    return let(F.filter(F.transform(F.split(host_, r"\."), fold), lambda x: x != ""), own)


def identify(url: Column) -> Column:
    """struct(platform, slug, tenant, site, dc, host, resolves) of the board that a URL belongs to, or null: Eightfold,
    Workday and Oracle by their own forms, then boards named by path or host, then SuccessFactors and Avature by
    their paths on an employer's own host. A URL without a scheme is taken as https."""
    raw = F.trim(url)
    full = F.when(raw.startswith("//"), F.concat(F.lit("https:"), raw)).when(raw.contains("//"), raw).otherwise(F.concat(F.lit("https://"), raw))
    path = lambda f: F.coalesce(F.nullif(F.regexp_extract(f, _PARTS, 3), F.lit("")), F.lit("/"))
    parts = lambda f: F.struct(f.alias("full"), scheme(f).isin("http", "https").alias("ok"), host(f).alias("h"), F.slice(F.split(path(f), "/"), 2, 1000).alias("segments"))
    return let(let(full, parts), _identified)


def _behind(segments: Column, runs: tuple, needed: bool) -> Column:
    """``segments`` without the first of ``runs`` that they begin with; null if one is needed and none is there."""
    out = F.lit(None).cast("array<string>") if needed else segments
    for run in reversed(runs):
        out = F.when(F.slice(segments, 1, len(run)) == F.array(*[F.lit(x) for x in run]), F.slice(segments, len(run) + 1, 1000)).otherwise(out)
    return out


def _identified(x: Column) -> Column:
    full, ok, h, segments, none = x["full"], x["ok"], x["h"], x["segments"], F.lit(None).cast("string")
    small = F.transform(segments, F.lower)
    at = lambda xs, i: F.coalesce(F.get(xs, F.lit(i)), F.lit(""))

    def found(platform: str, slug: Column, when: Column, **more: Column) -> Column:
        fields = [F.lit(platform).alias("platform"), slug.alias("slug"), *[more.get(k, none).alias(k) for k in ("tenant", "site", "dc", "host")], more.get("resolves", F.lit(True)).alias("resolves")]
        return F.when(ok & (h != "") & F.coalesce(when, F.lit(False)), F.struct(*fields))

    labels = F.split(h, r"\.")
    label = at(labels, 0)
    domain = _vanity(F.lower(F.regexp_extract(full, r"[?&]domain=([^&#]+)", 1)))
    out = [
        found("eightfold", label, h.endswith(".eightfold.ai")),
        found("eightfold", domain, at(small, 0).startswith("careers") & domain.isNotNull()),
    ]
    # Listings of a tenant's interface stand three segments deep; a locale may lead what is left.
    inner = F.when((at(small, 0) == "wday") & (at(small, 1) == "cxs") & (F.size(segments) > 3), F.slice(segments, 4, 1000)).otherwise(segments)
    inner = let(inner, lambda s: F.when((F.size(s) > 1) & _is_locale(at(s, 0)), F.slice(s, 2, 1000)).otherwise(s))
    first = F.get(F.filter(inner, lambda s: s != ""), F.lit(0))
    tenants = h.endswith(".myworkdayjobs.com") & (F.size(labels) == 4) & _is_name(label, most=253) & at(labels, 1).startswith("wd") & (F.length(at(labels, 1)) > 2) & (F.translate(F.substring(at(labels, 1), 3, 9), _DIGITS, "") == "")
    out.append(found("workday", label, tenants, tenant=label, dc=at(labels, 1), site=F.when(~F.lower(first).isin("job", "jobs"), first)))
    site = F.get(segments, F.array_position(small, "sites").cast("int"))
    site = F.when(F.array_contains(small, "sites") & _is_site(site), site)
    candidates = F.concat(F.lit("/"), F.array_join(small, "/")).contains("/hcmui/candidateexperience")
    out.append(found("oracle_cloud", label, h.endswith(".oraclecloud.com") & candidates & _is_name(label), host=h, site=site, resolves=site.isNotNull()))
    for board in PATH_BOARDS:
        rest = _behind(segments, board.get("needs", board.get("before", ())), "needs" in board)
        if board.get("locale"):
            rest = let(rest, lambda s: F.when((F.size(s) > 1) & _is_locale(at(s, 0)), F.slice(s, 2, 1000)).otherwise(s))
        slug = F.get(rest, F.lit(0))
        slug = slug if board["name"] == "cased" else F.lower(slug)
        out.append(found(board["platform"], slug, h.isin(*board["hosts"]) & _is_name(slug, **_NAMES[board["name"]]) & ~slug.isin(*RESERVED)))
    for platform, before, after in HOST_BOARDS:
        slug = F.substr(h, F.lit(len(before) + 1), F.length(h) - (len(before) + len(after)))
        out.append(found(platform, slug, h.startswith(before) & h.endswith(after) & _is_name(slug, most=253)))
    own = _vanity(h)
    goes = ((at(small, 0) == "go") & (F.size(segments) > 1)) | ((at(small, 0) == "content") & (F.size(segments) == 2) & (at(segments, 1) == ""))
    out.append(found("successfactors", own, goes & own.isNotNull()))
    tongue = F.split(at(small, 0), "_")
    led = (F.size(tongue) == 2) & F.forall(tongue, lambda t: (F.length(t) == 2) & (F.translate(t, _SMALL, "") == ""))
    named = (F.translate(at(small, 1), _SMALL + _DIGITS + "_-", "") == "") & (at(small, 1) != "") & (F.length(at(small, 2)) > 0) & (F.translate(F.substring(at(small, 2), 1, 1), _SMALL + _DIGITS + "_-", "") == "")
    out.append(found("avature", own, led & named & own.isNotNull(), resolves=F.lit(False)))
    return F.coalesce(*out)
