"""Names and addresses of people: normalisation and likeness."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Domains that say nothing about a person, and the pattern of an address.
NO_DOMAINS = ["@server.fake", "@server.com", "@example.com", "@email.com"]
EMAIL = r"[a-z0-9!#$%&'*+/=?^_`{|}~-]+(?:\.[a-z0-9!#$%&'*+/=?^_`{|}~-]+)*@[a-z0-9-]+(?:\.[a-z0-9-]+)*"


def clean_email(email: Column) -> Column:
    """Lower-cased address, null if it is none or of a domain that says nothing; '.(none)' addresses stay."""
    e = F.lower(F.trim(email))
    silent = "|".join(d.replace(".", r"\.") for d in NO_DOMAINS)
    return F.when(e.rlike(rf"^(?!none$).*(?:{EMAIL}|\.\(none\)$)") & ~e.rlike(rf"(?:{silent})$"), e)


def author(line: Column) -> Column:
    """struct(name, email, first_name, last_name, user_name) of `name <address>`.

    The last name begins at the last capital or after the last of + - _ , and dot,
    whichever comes later; the first name is the whole name, as it was defined.
    """
    name = F.trim(F.substring_index(line, "<", 1))
    email = F.trim(F.regexp_extract(line, "<([^>]*)", 1))
    last = F.trim(F.regexp_extract(name, r"([\p{Lu}]?[^+\-_,.\p{Lu}]*)$", 1))
    return F.struct(name.alias("name"), email.alias("email"), name.alias("first_name"), last.alias("last_name"), F.trim(F.substring_index(email, "@", 1)).alias("user_name"))


def author_likeness(a: Column, b: Column, halving: bool = True) -> Column:
    """struct of six likenesses of two authors: their five parts, and a's first name to b's last name."""
    like = lambda x, y: jaro_winkler(x, y, halving)
    same = [like(a[f], b[f]).alias(f) for f in ("name", "email", "first_name", "last_name", "user_name")]
    return F.struct(*same, like(a["first_name"], b["last_name"]).alias("inverse_first_name"))


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), where value is evaluated once for each row."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _matched(a: Column, b: Column, reach: Column) -> Column:
    """For each character of a the place of the first equal one of b within reach that no earlier character has, or -1."""

    def step(taken: Column, i: Column) -> Column:
        near = F.slice(b, F.greatest(i - reach, F.lit(0)) + 1, F.greatest(i + reach - F.greatest(i - reach, F.lit(0)) + 1, F.lit(0)))
        begin = F.greatest(i - reach, F.lit(0))
        free = F.filter(F.transform(near, lambda c, j: F.when((c == F.get(a, i)) & ~F.array_contains(taken, begin + j), begin + j)), lambda j: j.isNotNull())
        return F.concat(taken, F.array(F.coalesce(F.get(free, F.lit(0)), F.lit(-1))))

    return F.aggregate(F.sequence(F.lit(0), F.size(a) - 1), F.array().cast("array<int>"), step)


def _apart(a: Column, b: Column, at: Column, halving: bool) -> Column:
    """Half the matched characters that differ from the matched one of b in the same order; if halving, halved at every character of a."""
    right = F.transform(F.array_sort(F.filter(at, lambda j: j >= 0)), lambda j: F.get(b, j))
    if not halving:
        left = F.filter(F.zip_with(a, at, lambda c, j: F.when(j >= 0, c)), lambda c: c.isNotNull())
        differ = F.size(F.filter(F.zip_with(left, right, lambda x, y: x != y), lambda d: d))
        return F.floor(differ / 2).cast("double")

    def both(places: Column) -> Column:
        begin = F.struct(F.lit(0.0).alias("apart"), F.lit(0).alias("k"))

        def step(was: Column, x: Column) -> Column:
            hit = x["j"] >= 0
            more = F.when(hit & (x["c"] != F.get(places, was["k"])), 1.0).otherwise(0.0)
            return F.struct(((was["apart"] + more) / 2).alias("apart"), (was["k"] + hit.cast("int")).alias("k"))

        return F.aggregate(F.arrays_zip(a.alias("c"), at.alias("j")), begin, step)["apart"]

    return _let(right, both)


def jaro_winkler(a: Column, b: Column, halving: bool = True) -> Column:
    """Jaro likeness of two texts, raised above 0.7 by up to four equal first characters; null if either is null.

    Characters are matched in arrays, so no row leaves the JVM.  With halving the
    count of swapped characters is halved at every character, as it was defined; without, once.
    """

    def likeness(x: Column, y: Column) -> Column:
        reach = F.floor(F.greatest(F.size(x), F.size(y)) / 2).cast("int") - 1

        def told(at: Column) -> Column:
            n = F.size(F.filter(at, lambda j: j >= 0)).cast("double")
            jaro = (n / F.size(x) + n / F.size(y) + (n - _apart(x, y, at, halving)) / n) / 3
            return F.when(n == 0, 0.0).otherwise(jaro)

        return _let(_matched(x, y, reach), told)

    def raised(d: Column) -> Column:
        same = lambda k: F.substring(a, 1, k) == F.substring(b, 1, k)
        alike = sum(((F.least(F.length(a), F.length(b)) >= k) & same(k)).cast("int") for k in range(1, 5))
        return F.when(d > 0.7, d + 0.1 * alike * (1 - d)).otherwise(d)

    d = F.when(a == b, 1.0).when((a == "") | (b == ""), 0.0).otherwise(_let(F.split(a, ""), lambda x: _let(F.split(b, ""), lambda y: likeness(x, y))))
    return F.when(a.isNotNull() & b.isNotNull(), _let(d, raised))
