"""Addresses in every spelling against the standard library, and boards by the parts of their URLs."""

import socket
from ipaddress import ip_address

from pyspark.sql import functions as F

from gristmill.functions import urls

HOSTS = [
    "0.0.0.0", "0.1.2.3", "1.1.1.1", "8.8.8.8", "9.255.255.255", "10.0.0.0", "10.255.255.255", "11.0.0.0", "100.63.255.255", "100.64.0.0", "100.127.255.255", "100.128.0.0",
    "126.255.255.255", "127.0.0.1", "127.1", "127.0.1", "128.0.0.0", "169.253.255.255", "169.254.169.254", "169.255.0.0", "172.15.255.255", "172.16.0.1", "172.31.255.255", "172.32.0.0",
    "192.0.0.1", "192.0.0.9", "192.0.0.10", "192.0.0.255", "192.0.1.0", "192.0.2.1", "192.0.3.1", "192.167.255.255", "192.168.1.1", "192.169.0.0", "198.17.255.255", "198.18.0.1", "198.19.255.255",
    "198.20.0.0", "198.51.100.7", "198.51.101.0", "203.0.113.9", "203.0.114.0", "223.255.255.255", "224.0.0.1", "239.255.255.255", "240.0.0.1", "255.255.255.255", "2130706433", "0x7f000001",
    "0x7f.1", "017700000001", "010.0.0.1", "0x0a.0.0.1", "3232235521", "134744072", "0x08080808", "256.1.1.1", "08.1.1.1", "1.2.3.4.5", "999999999999", "1.2.3.", "example.com", "a.localhost", "localhost", "LOCALHOST.",
    "[::]", "[::1]", "[::2]", "[::ffff:127.0.0.1]", "[::ffff:8.8.8.8]", "[::ffff:a00:1]", "[64:ff9b::1]", "[64:ff9b:1::1]", "[100::1]", "[100:0:0:1::1]", "[2001::1]", "[2001:1::1]", "[2001:1::3]", "[2001:3::7]",
    "[2001:4:112::1]", "[2001:20::1]", "[2001:200::1]", "[2001:db8::1]", "[2001:4860:4860::8888]", "[2002::1]", "[2606:4700::1111]", "[3fff:1000::1]", "[fc00::1]", "[fdff::1]", "[fe00::1]", "[fe80::1]",
    "[fe80::1%25eth0]", "[febf::1]", "[fec0::1]", "[ff02::1]", "[1:2:3:4:5:6:7:8]",
]


def public_by_hand(host):
    name = host.strip("[]").split("%")[0].rstrip(".").lower()
    if not name or name == "localhost" or name.endswith(".localhost"):
        return False
    try:
        address = ip_address(name)
    except ValueError:
        try:
            address = ip_address(socket.inet_aton(name))
        except OSError:
            return True
    return address.is_global


def test_addresses_in_every_spelling(spark):
    rows = [(h, f"https://{h}{end}") for h in HOSTS for end in ("/", ":8443/a?b#c", "")]
    got = spark.createDataFrame(rows, "h string, u string").select("h", "u", urls.public_https_url(F.col("u")).alias("public")).collect()
    wrong = [(r["u"], r["public"]) for r in got if r["public"] != public_by_hand(r["h"])]
    assert not wrong and len(HOSTS) >= 60
    bad = ["http://1.1.1.1/", "https://u@1.1.1.1/", "https://u:p@a.org/", "https://a.org/x y", "https://", "", "ftp://a.org"]
    assert not any(r[0] for r in spark.createDataFrame([(u,) for u in bad], "u string").select(urls.public_https_url(F.col("u"))).collect())


def test_boards_by_the_parts_of_their_urls(spark):
    cases = {
        "https://boards.greenhouse.io/fr-CA/acme/jobs/1": ("greenhouse", "acme"), "https://boards-api.greenhouse.io/v1/boards/acme/jobs": ("greenhouse", "acme"), "https://boards.greenhouse.io/v1": None,
        "https://jobs.lever.co/AcMe/1": ("lever", "AcMe"), "https://jobs.ashbyhq.com/a.b-c": ("ashby", "a.b-c"), "https://jobs.ashbyhq.com/a.b-": None, "https://api.ashbyhq.com/posting-api/job-board/Acme": ("ashby", "acme"),
        "https://join.com/acme": None, "https://join.com/companies/acme": ("join", "acme"), "https://api.collage.co/v1/positions/acme": ("collage", "acme"), "https://apply.workable.com/acme/j/1": ("workable", "acme"),
        "https://a.b.bamboohr.com/": None, "https://careers-acme.icims.com/jobs": ("icims", "acme"), "https://acme.icims.com/": None, "https://-a.breezy.hr": None, "https://" + "a" * 70 + ".example.org/": None,
        "https://acme.wd5.myworkdayjobs.com/wday/cxs/acme/Site/jobs": ("workday", "acme"), "https://acme.wdx.myworkdayjobs.com/Site": None, "https://x.fa.oraclecloud.com/hcmUI/CandidateExperience/en": ("oracle_cloud", "x"),
        "https://careers.acme.com/content/": ("successfactors", "acme"), "https://careers.acme.com/content/x": None, "https://jobs.acme.com/fr_ca/Careers/Search-1": ("avature", "acme"), "https://jobs.acme.com/fra_ca/a/b": None, "nothing": None,
    }
    got = spark.createDataFrame([(u,) for u in cases], "u string").select("u", urls.identify(F.col("u")).alias("p")).collect()
    assert {r["u"]: (r["p"]["platform"], r["p"]["slug"]) if r["p"] else None for r in got} == cases
    of = lambda f: spark.range(1).select(f).first()[0]
    assert of(urls.oracle_target(F.lit("X.fa.oraclecloud.com"), F.lit("CX_1")))["host"] == "x.fa.oraclecloud.com" and of(urls.oracle_target(F.lit("nohost"), F.lit("CX_1"))) is None
    assert of(urls.safe_slug(F.lit("Acme-1"))) and not of(urls.safe_slug(F.lit("a/b"))) and of(urls.safe_slug(F.lit("AcMe"), "cased")) and not of(urls.workday_target(F.lit("acme"), F.lit("S"), F.lit("wd1234")).isNotNull())
