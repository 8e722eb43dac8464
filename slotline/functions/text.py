"""Column functions over text: digests, versions, listings, rewrites, addresses."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def sri(hex_digest: Column) -> Column:
    return F.concat(F.lit("sha256-"), F.base64(F.unhex(hex_digest)))


def content_etag(content: Column) -> Column:
    return F.concat(F.lit('"'), F.substring(F.sha2(content, 256), 1, 32), F.lit('"'))


def versions_in(text: Column, pattern: str = r"v([0-9]+(?:\.[0-9]+)*)") -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(1))


def natural_key(version: Column) -> Column:
    """Numbers of a dotted version; arrays compare element by element."""
    return F.transform(F.split(version, r"\."), lambda x: x.cast("int"))


def drop_lines(text: Column, pattern: str) -> Column:
    return F.array_join(F.filter(F.split(text, "\n"), lambda line: ~line.rlike(pattern)), "\n")


#: The files of a repository that a client asks for over plain HTTP, and the folder of its objects.
CLONE_FILES = ["HEAD", "info/refs", "packed-refs", "description"]
CLONE_FOLDER = "objects/"


def clone_rewrite(path: Column) -> Column:
    """/owner/repo.git/data to /repo.git/data for the data files of a repository; others unchanged."""
    start, owner, repository, data = (F.get(F.split(path, "/", 4), i) for i in range(4))
    wanted = data.isin(*CLONE_FILES) | data.startswith(CLONE_FOLDER)
    fits = (start == "") & (F.length(owner) > 0) & repository.endswith(".git") & (F.length(repository) > 4) & wanted
    return F.when(F.coalesce(fits, F.lit(False)), F.concat_ws("/", F.lit(""), repository, data)).otherwise(path)


def address(dotted: Column) -> Column:
    """A dotted quad as a number."""
    part = F.split(dotted, r"\.")
    return reduce(lambda total, i: total * 256 + part[i].cast("long"), range(1, 4), part[0].cast("long"))


def subnet(cidr: str) -> tuple[int, int]:
    """The first and last address of a subnet."""
    base, bits = cidr.split("/")
    n = reduce(lambda t, x: t * 256 + int(x), base.split("."), 0)
    size = 1 << (32 - int(bits))
    low = n - n % size
    return low, low + size - 1


def in_subnets(dotted: Column, cidrs: list[str]) -> Column:
    """Whether an address is in one of a few subnets: a disjunction of ranges that filters push down."""
    ip = address(dotted)
    return reduce(lambda a, b: a | b, [ip.between(*subnet(c)) for c in cidrs], F.lit(False))


def first_match(path: Column, rules: list[tuple[str, str]], default: str = "include") -> Column:
    """The verdict of the first rule (verdict, pattern) that matches."""
    verdict = None
    for word, pattern in rules:
        verdict = (F.when if verdict is None else verdict.when)(path.rlike(pattern), word)
    return F.lit(default) if verdict is None else verdict.otherwise(default)


def points(flat: str) -> list[tuple[float, float]]:
    numbers = [float(x) for x in flat.split(",")]
    return list(zip(numbers[::2], numbers[1::2]))


def inside(x: Column, y: Column, polygon: list[tuple[float, float]]) -> Column:
    """Even-odd ray test: an odd number of edges lies to the right of the point."""
    crossings = []
    for (x1, y1), (x2, y2) in zip(polygon, polygon[1:] + polygon[:1]):
        if y1 != y2:
            cuts = (F.lit(y1) > y) != (F.lit(y2) > y)
            at = (F.lit(x2) - F.lit(x1)) * (y - F.lit(y1)) / (F.lit(y2) - F.lit(y1)) + F.lit(x1)
            crossings.append((cuts & (x < at)).cast("int"))
    return reduce(lambda a, b: a + b, crossings) % 2 == 1
