"""Links to documents: normal form, syntactic safety, file name."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: the form of an arXiv id.
ARXIV_ID = r"\d{4}\.\d{4,5}(v\d+)?"
#: IPv4 ranges that are not public, as dotted network and prefix length.
CLOSED_RANGES = (
    ("0.0.0.0", 8), ("10.0.0.0", 8), ("100.64.0.0", 10), ("127.0.0.0", 8), ("169.254.0.0", 16), ("172.16.0.0", 12),
    ("192.0.0.0", 24), ("192.0.2.0", 24), ("192.168.0.0", 16), ("198.18.0.0", 15), ("198.51.100.0", 24), ("203.0.113.0", 24),
    ("224.0.0.0", 4), ("240.0.0.0", 4),
)


def normalized(url: Column) -> Column:
    """arXiv ids and pages become the paper's link, http becomes https, a bare host gets https; null for any other scheme."""
    u = F.trim(url)
    paper = F.regexp_extract(u, ARXIV_ID, 0)
    link = F.concat(F.lit("https://arxiv.org/pdf/"), paper)
    secure = F.when(u.startswith("http://"), F.concat(F.lit("https://"), F.substr(u, F.lit(8)))).otherwise(u)
    return (
        F.when(u.rlike(f"^{ARXIV_ID}$"), link)
        .when(F.contains(u, F.lit("arxiv.org")) & (paper != ""), link)
        .when(secure.startswith("https://"), secure)
        .when(F.contains(secure, F.lit("://")), F.lit(None).cast("string"))
        .otherwise(F.concat(F.lit("https://"), secure))
    )


def host(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]+)", 1))


def ip_number(name: Column) -> Column:
    """A literal IPv4 address as a number, else null."""
    parts = F.split(name, r"\.")
    value = sum((parts[i].cast("long") * 256 ** (3 - i) for i in range(4)), F.lit(0))
    return F.when(name.rlike(r"^(25[0-5]|2[0-4]\d|1?\d?\d)(\.(25[0-5]|2[0-4]\d|1?\d?\d)){3}$"), value)


def refusal(url: Column) -> Column:
    """Why a link is refused without asking the name service: scheme, host, or address; null if nothing speaks against it."""
    name = host(url)
    number = ip_number(name)
    closed = F.lit(False)
    for network, bits in CLOSED_RANGES:
        a, b, c, d = (int(x) for x in network.split("."))
        size = 2 ** (32 - bits)
        closed = closed | (F.floor(number / size) == (((a * 256 + b) * 256 + c) * 256 + d) // size)
    return F.when(~url.startswith("https://"), "scheme").when(name == "", "host").when(number.isNotNull() & closed | name.isin("localhost"), "address")


def file_name(url: Column) -> Column:
    """The last part of the path, with .pdf if it lacks it; document.pdf if there is none."""
    path = F.regexp_replace(F.regexp_replace(url, r"[?#].*$", ""), r"^[A-Za-z][A-Za-z0-9+.-]*://[^/]*", "")
    name = F.coalesce(F.nullif(F.element_at(F.split(path, "/"), -1), F.lit("")), F.lit("document"))
    return F.when(F.lower(name).endswith(".pdf"), name).otherwise(F.concat(name, F.lit(".pdf")))
