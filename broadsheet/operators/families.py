"""Release families: a grammar of release titles and tags, and the window fold that puts one release of each target together.

A release names its repository in its address. Its title and tag say which product line it belongs to and which target of it it is for
(a package of a scope, a component, a language, a client or plugin). The grammar is column expressions only: each
kind of release is a pattern over title and tag with tests that they agree; the first kind that fits counts.

Releases of one line within 24 hours form a family, with each target once. Lines of clients, packages and plugins must also
share a change reference: the fold keeps the references all members have in common, which only shrink. The fold is
sequential; it runs for each run of days
on which a line has releases and holds their times, targets and references.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.titles import trimmed
from .folders import written

WINDOW = 24 * 3600

# How a release tag names a language, and what a plain title calls a client of that language.
LANGUAGES = {
    "python": "python", "py": "python", "dotnet": "dotnet", "net": "dotnet", "java": "java", "javascript": "node", "node": "node", "nodejs": "node", "js": "node", "typescript": "node", "ts": "node",
    "go": "go", "golang": "go", "rust": "rust", "ruby": "ruby", "php": "php", "swift": "swift", "kotlin": "kotlin",
}
CLIENT_LANGUAGES = {"node": "node", "nodejs": "node", "javascript": "node", "typescript": "node", "js": "node", "ts": "node", "py": "python", "python": "python"}
FAMILIES = ["plugin", "extension", "adapter", "integration", "cli", "sdk", "provider"]

NAME = r"[A-Za-z0-9](?:[A-Za-z0-9._-]*[A-Za-z0-9])?"
SCOPED_NAME = r"[a-z0-9](?:[a-z0-9._-]*[a-z0-9])?"
#: Three numbers, with anything of letters, digits, dots, hyphens and pluses after the first hyphen or plus.
LOOSE = r"[0-9]+\.[0-9]+\.[0-9]+(?:[-+][A-Za-z0-9.+-]*[A-Za-z0-9])?"
_NUMBER, _WORDS = "(?:0|[1-9][0-9]*)", r"[0-9A-Za-z-]+(?:\.[0-9A-Za-z-]+)*"
_PRE = r"(?:0|[1-9][0-9]*|[0-9]*[A-Za-z-][0-9A-Za-z-]*)"
STRICT = rf"{_NUMBER}\.{_NUMBER}\.{_NUMBER}(?:-{_PRE}(?:\.{_PRE})*)?(?:\+{_WORDS})?"


def plain(c: Column) -> Column:
    return F.lower(F.regexp_replace(c, "[^A-Za-z0-9]+", ""))


def whole(c: Column, pattern: str) -> Column:
    """Whether a pattern fits all of ``c`` (a line end in it is no end)."""
    return c.rlike(rf"\A(?:{pattern})\z")


def part(c: Column, pattern: str, k: int) -> Column:
    return F.nullif(F.regexp_extract(c, rf"(?s)\A(?:{pattern})\z", k), F.lit(""))


def of_map(known: dict[str, str], key: Column) -> Column:
    return F.create_map(*[F.lit(x) for kv in known.items() for x in kv])[key]


def bound(fields: dict[str, Column], made) -> Column:
    """``made`` of a struct of ``fields``, each of which is evaluated once."""
    return F.transform(F.array(F.struct(*[c.alias(name) for name, c in fields.items()])), made)[0]


def _line(fits: Column, kind: str, line: Column, target: Column, version: Column, shares: bool, strict: bool) -> Column:
    """One kind of release: its line, target and version; ``shares``: members must not contradict in changes, ``strict``: each must name one of the common changes."""
    return F.when(fits, F.struct(F.lit(kind).alias("kind"), line.alias("line"), target.alias("target"), version.alias("version"), F.lit(shares).alias("shares"), F.lit(strict).alias("strict")))


def _scope(r: Column) -> Column:
    """``@scope/package@version``, the tag the same with @ and / escaped or not: one line a scope and version."""
    scoped = rf"@({SCOPED_NAME})/({SCOPED_NAME})@({STRICT})"
    tag = F.regexp_replace(F.regexp_replace(r["tag"], "%40", "@"), "%2[fF]", "/")
    fits = r["named"] & whole(r["title"], scoped) & whole(r["tag"], r"(?:[A-Za-z0-9@._+-]|%40|%2[fF])+") & (tag == r["title"])
    line = F.concat(r["repo"], F.lit(":npm-scope:"), part(r["title"], scoped, 1), F.lit(":"), part(r["title"], scoped, 3))
    return _line(fits, "scope", line, F.concat(F.lit("npm:"), part(r["title"], scoped, 2)), part(r["title"], scoped, 3), False, False)


def _package(r: Column) -> Column:
    """``name==version``: the repository itself, or a component of it that the tag names."""
    pinned = rf"({NAME})==({STRICT})"
    fields = {"package": F.lower(part(r["title"], pinned, 1)), "version": part(r["title"], pinned, 2), "tag": F.regexp_replace(r["tag"], "%3[dD]", "="), "repository": F.lower(r["repository"]), "repo": r["repo"], "named": r["named"]}

    def made(p: Column) -> Column:
        component = F.lower(part(p["tag"], rf"({NAME})==(.*)", 1))
        as_part = (part(p["tag"], rf"({NAME})==(.*)", 2) == p["version"]) & (p["package"] == F.concat(p["repository"], F.lit("-"), component))
        fits = p["named"] & p["package"].isNotNull() & ~p["tag"].contains("%") & F.when(p["tag"].contains("=="), as_part).otherwise((p["tag"] == p["version"]) & (p["package"] == p["repository"]))
        return _line(fits, "package", F.concat(p["repo"], F.lit(":package")), F.coalesce(F.concat(F.lit("component:"), component), F.lit("core")), p["version"], True, True)

    return bound(fields, made)


def _language(r: Column) -> Column:
    """Title and tag ``language-version``: a line for stable ones and one for previews."""
    spoken = rf"([^-]*)-v?({STRICT})"
    language, version = of_map(LANGUAGES, part(r["tag"], spoken, 1)), part(r["tag"], spoken, 2)
    channel = F.when(F.split_part(version, F.lit("+"), F.lit(1)).contains("-"), "preview").otherwise("stable")
    return _line(r["named"] & (r["title"] == r["tag"]) & language.isNotNull(), "language", F.concat(r["repo"], F.lit(":language:"), channel), language, version, False, False)


def _client_or_plugin(r: Column) -> Column:
    """``Product Target Family (vX)`` with a tag that names the target: clients are one line, each family of plugins another."""
    versioned = rf"(?:(.*)-)?v({LOOSE})"
    one = {"head": F.coalesce(part(r["tag"], versioned, 1), F.lit("")), "version": part(r["tag"], versioned, 2), "title": r["title"], "repo": r["repo"], "repository": plain(r["repository"])}

    def with_words(v: Column) -> Column:
        own = F.when(v["title"].endswith(F.concat(F.lit("(v"), v["version"], F.lit(")"))), F.substring(v["title"], F.lit(1), F.length(v["title"]) - F.length(v["version"]) - 3))
        words = F.filter(F.split(own, r"(?U)\s+"), lambda w: w != "")
        return bound({"family": F.lower(F.try_element_at(words, F.lit(-1))), "names": F.slice(words, 1, F.greatest(F.size(words) - 1, F.lit(0))), "v": v}, with_names)

    def with_names(w: Column) -> Column:
        host = (w["family"] == "provider") & (F.lower(F.try_element_at(w["names"], F.lit(-1))) == "sdk")
        names = F.when(w["family"] == "provider", F.slice(w["names"], 1, F.greatest(F.size(w["names"]) - 1, F.lit(0)))).otherwise(w["names"])
        return bound({"family": w["family"], "names": names, "host": F.coalesce(host, F.lit(False)), "v": w["v"]}, with_target)

    def with_target(w: Column) -> Column:
        # the shortest beginning that spells the repository, but for one word at least that names the target
        spelt = lambda n: (n < F.size(w["names"])) & (plain(F.array_join(F.slice(w["names"], 1, n), " ")) == w["v"]["repository"])
        begin = F.coalesce(F.try_element_at(F.filter(F.sequence(F.lit(1), F.greatest(F.size(w["names"]), F.lit(1))), spelt), F.lit(1)), F.lit(0))
        target = F.array_join(F.slice(w["names"], begin + 1, F.greatest(F.size(w["names"]), F.lit(1))), " ")
        return bound({"family": w["family"], "host": w["host"], "begin": begin, "target": target, "v": w["v"]}, agreed)

    def agreed(w: Column) -> Column:
        family, target, head = w["family"], plain(w["target"]), plain(w["v"]["head"])
        tongue = lambda c: F.coalesce(of_map(CLIENT_LANGUAGES, c), c)
        after, before = F.substring(head, F.length(family) + 1, F.length(head)), F.substring(head, F.lit(1), F.length(head) - F.length(family))
        bare = F.when(head.startswith(family), after).when(head.endswith(family), before).otherwise(head)
        as_client = ((family == "sdk") & (w["v"]["head"] == "")) | ((family == "cli") & (w["v"]["head"] == "cli")) | (tongue(bare) == tongue(target))
        client = family.isin("cli", "sdk", "provider")
        fits = w["v"]["version"].isNotNull() & ~w["v"]["version"].contains("-v") & family.isin(FAMILIES) & ((family != "provider") | w["host"]) & ((w["begin"] > 0) | (family == "provider")) & (w["target"] != "")
        fits = F.coalesce(fits & F.when(client, as_client).otherwise((head == target) | (head == F.concat(target, family))), F.lit(False))
        version, line = F.concat(F.lit("v"), w["v"]["version"]), lambda name: F.concat(w["v"]["repo"], F.lit(":"), name)
        of_client = _line(fits & client, "client", line(F.lit("client")), F.concat(tongue(target), F.lit(":"), family), version, True, True)
        return F.coalesce(of_client, _line(fits & ~client, "plugin", line(family), target, version, True, False))

    return bound(one, with_words)


def release_identity(url: Column, title: Column) -> Column:
    """kind, line, target, version, shares and strict of a release page's address and title; null if they do not agree on one.

    Addresses are ``https://github.com/<owner>/<repository>/releases/tag/<tag>``.
    """
    page = r"https://github\.com/([^/]+)/([^/]+)/releases/tag/([^/?#]+)/?"
    repository = part(url, page, 2)
    fields = {"repository": repository, "tag": part(url, page, 3), "title": trimmed(title), "repo": F.lower(F.concat(part(url, page, 1), F.lit("/"), repository)), "named": whole(repository, NAME)}
    by_form = lambda r: F.when(r["title"].startswith("@"), _scope(r)).when(r["title"].contains("=="), _package(r)).otherwise(F.coalesce(_language(r), _client_or_plugin(r)))
    return bound(fields, by_form)


def change_references(url: Column, text: Column) -> Column:
    """The set of changes of its own repository that a release's text names: #123, or the address of a pull request or issue."""
    repo = F.lower(F.regexp_extract(url, r"^https://github\.com/([^/]+/[^/]+)/", 1))
    may = F.filter(F.split(text, r"(?U)\s+"), lambda w: w.contains("#") | w.contains("https://github.com/"))
    words = F.transform(may, lambda w: F.regexp_replace(w, r"^[()\[\],.;。]+|[()\[\],.;。]+$", ""))
    link = r"^https://github\.com/([^/]+/[^/]+)/(?:pull|issues)/([0-9]+)(?:[?#].*)?$"
    number = lambda w: F.when(w.rlike("^#[0-9]+$"), F.substring(w, F.lit(2), F.length(w))).when(F.lower(F.regexp_extract(w, link, 1)) == repo, F.regexp_extract(w, link, 2))
    return F.array_sort(F.array_distinct(F.filter(F.transform(words, number), lambda n: F.coalesce(n != "", F.lit(False)))))


def families(releases: DataFrame, as_of: int) -> DataFrame:
    """item, leader, place of each release in a family of its line; families of one are left out.

    ``releases``: item, published, identity (see ``release_identity``), changes (array of references). From the newest on,
    each release that no family has yet opens one and looks through its line from the newest on: who fits joins. One is left out that would
    stretch the family beyond 24 hours, or is for a target it has; then, for lines that share changes, one whose changes have nothing in common
    with the family's, or (strict lines) that has none.
    """
    # the grammar and the search for references are dear: each is evaluated once, and what it finds is written
    told = written(releases.where(F.col("published") <= as_of).select("item", "published", "changes", "identity"))
    known = told.where("identity is not null").select("item", "published", "changes", "identity.*")
    several = known.groupBy("line").agg(F.count("*").alias("n")).where("n > 1").select("line")

    def fold(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["published", "item"], ascending=[False, True])
        order = list(rows[["item", "published", "target"]].itertuples(index=False, name=None))
        changes = [frozenset(c) for c in rows["changes"]]
        shares, strict = bool(rows["shares"].iloc[0]), bool(rows["strict"].iloc[0])
        free, out = dict.fromkeys(range(len(order))), []
        while free:
            lead = next(iter(free))
            members, targets, common = [lead], {order[lead][2]}, changes[lead]
            low = high = order[lead][1]
            for k in free:
                _, at, target = order[k]
                if high - at > WINDOW:
                    break  # later ones are older still
                if k == lead or max(high, at) - min(low, at) > WINDOW or target in targets:
                    continue
                if shares:
                    if strict and not (common and changes[k]) or common and changes[k] and not common & changes[k]:
                        continue
                    if changes[k]:
                        common = common & changes[k] if common else changes[k]
                targets.add(target)
                low, high = min(low, at), max(high, at)
                members.append(k)
            for k in members:
                del free[k]
            if len(members) > 1:
                out += [(order[k][0], order[lead][0], place) for place, k in enumerate(members)]
        return pd.DataFrame(out, columns=["item", "leader", "place"])

    # a day without releases parts a line: what stands on its two sides is of no common family
    day = F.floor(F.col("published") / WINDOW)
    own = known.join(several, "line", "left_semi").withColumn("day", day)
    days = own.select("line", "day").distinct()
    fresh = F.col("day") > F.coalesce(F.lag("day").over(Window.partitionBy("line").orderBy("day")) + 1, F.col("day") - 1)
    runs = days.withColumn("run", F.sum(fresh.cast("int")).over(Window.partitionBy("line").orderBy("day")))
    return own.join(runs, ["line", "day"]).groupBy("line", "run").applyInPandas(fold, "item long, leader long, place int")
