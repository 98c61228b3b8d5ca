"""Main text of web pages, from the template that the pages of a host share."""

from __future__ import annotations

import re
import zlib
from collections import Counter, defaultdict
from functools import lru_cache
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rosterline.llm.common import column_function, recording, staged
from rosterline.session import remove_path

# Element names by their part in a page.
REGIONS = frozenset("html body header nav main article section aside footer form div dialog menu figure table fieldset".split())
BLOCKS = frozenset("p h1 h2 h3 h4 h5 h6 li ul ol dl dt dd pre blockquote tr td th caption figcaption br hr address summary details".split())
HIDDEN = frozenset("head script style noscript template iframe svg object textarea select button title math canvas".split())
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
ASIDE = frozenset("nav header footer aside form menu dialog fieldset".split())
ASIDE_NAMES = re.compile(
    r"^(ads?|advert\w*|sponsor\w*|promo\w*|banner\w*|sidebar\w*|menu\w*|nav\w*|footer\w*|header\w*|cookies?|notices?|consent|"
    r"comments?|comment-?list|disqus\w*|replies|share|social|related|breadcrumbs?|newsletter|subscribe|popup|modal|widgets?)$"
)
NUMBERS = re.compile(r"\d+")
LEAST_PAGES = 3  # of a host that a token must be on to tell template from text
NEAR = 4  # amounts of text that differ by no more than this factor count as a tie
MOST_BROADCAST = 16 << 20  # bytes of places sent to all tasks; more are joined by exchange
SALTS = 16  # parts into which the rows of a hot host's token are dealt


class PageBlocks(HTMLParser):
    """The tokens of a page in order: every region that opens, and every text block, with the path of regions that hold it."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.stack: list[tuple[str, str, int]] = []  # tag, its part of the path, level by its names
        self.hidden: list[str] = []
        self.tokens: list[tuple[str, str | None, str, int]] = [("", None, "", 1)]
        self.parts: list[str] = []

    def add(self, text: str | None):
        """A token: path, text, unit (the outermost region that by its name holds or leaves out a whole, else the path), level."""
        levels = [level for *_, level in self.stack]
        outermost = next((i for i, level in enumerate(levels) if level != 1), len(levels))
        level = 0 if 0 in levels else 2 if 2 in levels else 1
        names = [name for _, name, _ in self.stack]
        self.tokens.append(("/".join(names), text, "/".join(names[: outermost + 1]), level))

    def flush(self):
        text = " ".join("".join(self.parts).split())
        if text:
            self.add(text)
        self.parts = []

    def handle_starttag(self, tag, attrs):
        if self.hidden:
            # A page's own body ends a head that was never closed.
            if tag == "body" and self.hidden == ["head"]:
                self.hidden = []
            elif tag in HIDDEN:
                self.hidden.append(tag)
                return
            else:
                return
        if tag in HIDDEN:
            self.flush()
            self.hidden.append(tag)
        elif tag in REGIONS:
            self.flush()
            named = {key: (value or "").lower().split() for key, value in attrs if key in ("class", "id", "role")}
            # Ids, and numbers in names, can differ from page to page: they count for the level but not for the path.
            shared = sorted(NUMBERS.sub("#", name) for key, names in named.items() if key != "id" for name in names)
            level = named_level(tag, *[name for names in named.values() for name in names])
            self.stack.append((tag, ".".join([tag, *shared]).replace("/", "_"), level))
            self.add(None)
        elif tag in BLOCKS:
            self.flush()

    def handle_startendtag(self, tag, attrs):
        if tag in BLOCKS and not self.hidden:
            self.flush()

    def handle_endtag(self, tag):
        if self.hidden:
            if tag in self.hidden:
                del self.hidden[self.hidden.index(tag) :]
            return
        if tag in REGIONS:
            self.flush()
            names = [name for name, *_ in self.stack]
            if tag in names:
                del self.stack[len(names) - 1 - names[::-1].index(tag) :]
        elif tag in BLOCKS:
            self.flush()

    def handle_data(self, data):
        if not self.hidden:
            self.parts.append(data)


def page_tokens(html: str | None) -> list[tuple[str, str | None, str, int]]:
    parser = PageBlocks()
    parser.feed(html or "")
    parser.close()
    parser.flush()
    return parser.tokens


@lru_cache(maxsize=4096)
def named_level(tag: str, *names: str) -> int:
    """By the names alone: 0 for regions beside the main text, 2 for articles, else 1."""
    if tag in ASIDE or any(ASIDE_NAMES.match(name) for name in names):
        return 0
    return 2 if tag in ("article", "main") else 1


@column_function("array<struct<path:string,text:string,unit:string,named:int,n:int,first:boolean>>")
def tokens_of(pages: pd.Series) -> pd.Series:
    """The tokens of each page, with their number on it and whether this is the first."""
    out = []
    for html in pages:
        tokens = page_tokens(html)
        counts, seen, rows = Counter((path, text) for path, text, *_ in tokens), set(), []
        for path, text, unit, level in tokens:
            rows.append({"path": path, "text": text, "unit": unit, "named": level,
                         "n": counts[path, text], "first": (path, text) not in seen})
            seen.add((path, text))
        out.append(rows)
    return pd.Series(out, dtype=object)


def order_of(tokens: list) -> list[tuple[int, int, int, bool]]:
    """(vector, part, order, whether it repeats) of each class on a page, and of its part in each region.

    Part 0 is the whole class. A class of m tokens that occurs n times must give the same m tokens n times.
    """
    groups = defaultdict(list)
    for token in tokens:
        groups[token["vector"], 0].append(token["tok"])
        groups[token["vector"], token["own"]].append(token["tok"])
    out = []
    for (vector, part), seen in groups.items():
        size = len(set(seen))
        repeats = seen == seen[:size] * (len(seen) // size)
        out.append((vector, part, zlib.crc32(repr(seen[:size]).encode()), repeats))
    return out


def nest_of(tokens: list) -> list[tuple[int, int, int, bool]]:
    """(vector, part, place, whether it nests) of each occurrence of an ordered class on a page.

    The place is the class around it and the gap there. Of two classes that interleave, the one on fewer pages
    (or with fewer tokens) does not nest.
    """
    weight = {(t["vector"], t["part"]): (t["pages"], t["size"], t["vector"], t["part"]) for t in tokens}
    crossed: set = set()
    while True:
        open_, places, hit = [], set(), None  # open_: [class, tokens so far] from the outermost
        for token in tokens:
            name = (token["vector"], token["part"])
            if name in crossed:
                continue
            at = next((i for i, (each, _) in enumerate(open_) if each == name), None)
            if at is None:
                around = tuple(open_[-1]) if open_ else None
                places.add((name, zlib.crc32(repr(around).encode())))
                open_.append([name, 0])
                at = len(open_) - 1
            elif at < len(open_) - 1:
                hit = min((each for each, _ in open_[at:]), key=weight.get)
                break
            open_[at][1] += 1
            if open_[at][1] == token["size"]:
                open_.pop()
        if hit is None:
            return [(*name, place, True) for name, place in places] + [(*name, 0, False) for name in crossed]
        crossed.add(hit)


SIGNED = "array<struct<vector:long,part:long,sign:long,holds:boolean>>"


@column_function(SIGNED)
def orders(pages: pd.Series) -> pd.Series:
    return pd.Series([[dict(zip(("vector", "part", "sign", "holds"), each)) for each in order_of(tokens)] for tokens in pages], dtype=object)


@column_function(SIGNED)
def nests(pages: pd.Series) -> pd.Series:
    return pd.Series([[dict(zip(("vector", "part", "sign", "holds"), each)) for each in nest_of(tokens)] for tokens in pages], dtype=object)


def join_salted(many: DataFrame, few: DataFrame, by: list[str], how: str = "inner") -> DataFrame:
    """Join rows of pages with rows that are unique by host and token; the rows of a hot key are dealt to several tasks."""
    few = few.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return many.withColumn("_salt", F.pmod("rid", F.lit(SALTS)).cast("int")).join(few, [*by, "_salt"], how).drop("_salt")


def held_alike(pages: DataFrame, signs) -> DataFrame:
    """The classes (host, vector, part) that hold on every page, and with the same sign."""
    each = pages.select("host_key", F.explode(signs(F.col("tokens"))).alias("s")).select("host_key", "s.*")
    alike = each.groupBy("host_key", "vector", "part").agg(
        F.min("sign").alias("low"), F.max("sign").alias("high"), F.min(F.col("holds").cast("int")).alias("all_hold")
    )
    return alike.filter("all_hold = 1 and low = high").select("host_key", "vector", "part")


def template_texts(tokens: DataFrame) -> DataFrame:
    """host_key and tok of the text blocks that belong to the template of their host.

    Tokens are the openings of regions and the blocks, by path and text. A token's occurrence vector (its count on
    every page of the host) is kept as its sum of hashes of (page, count), so no host is ever gathered in one
    place; tokens of one host with equal vectors are an equivalence class. Blocks that are not in the class of
    their own region are left out, so that a text which some pages share does not count. A class is valid if its
    tokens come in the same relative order on every page, as often as they occur; of one that is not, the part in
    each region is judged alone. Valid classes must nest: none interleaves with another, and each lies in the
    same gap of the class around it on all pages. Blocks of valid, nested classes are template.
    """
    vector = F.sum(F.pmod(F.xxhash64("rid", "n"), F.lit(1 << 40)))
    seen = tokens.filter("first").groupBy("host_key", "tok", "own").agg(vector.alias("vector"), F.count("*").alias("pages"))
    seen = staged(seen.filter(F.col("pages") >= LEAST_PAGES), "vectors")
    regions = seen.filter("tok = own").select("host_key", "own", "vector")
    members = staged(seen.join(regions, ["host_key", "own", "vector"]), "members")
    on_page = F.array_sort(F.collect_list(F.struct("at", "tok", "own", "vector"))).alias("tokens")
    found = join_salted(tokens.select("host_key", "rid", "at", "tok"), members, ["host_key", "tok"])
    ordered = staged(held_alike(found.groupBy("rid", "host_key").agg(on_page), orders), "ordered")
    whole = ordered.filter("part = 0")
    parts = ordered.filter("part <> 0").join(whole.select("host_key", "vector"), ["host_key", "vector"], "left_anti")
    classed = members.join(whole, ["host_key", "vector"]).unionByName(
        members.withColumn("part", F.col("own")).join(parts, ["host_key", "vector", "part"])
    )
    sizes = classed.groupBy("host_key", "vector", "part").agg(F.count("*").alias("size"))
    classed = staged(classed.join(sizes, ["host_key", "vector", "part"]), "classes")
    on_page = F.array_sort(F.collect_list(F.struct("at", "vector", "part", "size", "pages"))).alias("tokens")
    found = join_salted(tokens.select("host_key", "rid", "at", "tok"), classed, ["host_key", "tok"])
    nested = held_alike(found.groupBy("rid", "host_key").agg(on_page), nests)
    return staged(classed.filter("tok <> own").join(nested, ["host_key", "vector", "part"]).select("host_key", "tok"), "templates")


def chosen(units: list) -> list[int]:
    """The places of a page's blocks that are main text; see ``main_text``."""
    slots = [u for u in units if len(u["slots"])]
    names = [at for u in units if u["named"] == max(v["named"] for v in units) > 0 for at in u["blocks"]]
    if not slots:
        return names
    known = units[0]["pages"] >= LEAST_PAGES
    most = max(u["amount"] for u in slots)
    top = max((u for u in slots if not known or u["amount"] * NEAR >= most), key=lambda u: (u["named"], u["amount"], u["unit"]))
    if top["named"]:
        return [at for u in slots if u["named"] >= 1 + (top["named"] == 2) for at in u["slots"]]
    if not known or any(u["named"] and u["whole"] * NEAR >= top["amount"] for u in units):
        return names
    return [at for u in slots if u["named"] or u is top for at in u["slots"]]


@column_function("array<int>")
def chosen_places(pages: pd.Series) -> pd.Series:
    return pd.Series([sorted(int(at) for at in chosen(list(units))) for units in pages], dtype=object)


def slots_and_amounts(parsed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Per page and slot its blocks and how much text they have, and the means of these over each host."""
    each = parsed.select("host_key", "rid", F.posexplode("tokens").alias("at", "b"))
    tokens = staged(each.select(
        "host_key", "rid", "at", F.xxhash64("b.path", "b.text").alias("tok"), F.xxhash64("b.path").alias("own"),
        F.xxhash64("b.unit").alias("unit"), "b.named", F.length("b.text").alias("chars"), "b.n", "b.first",
    ), "hashes")
    fixed = template_texts(tokens).withColumn("fixed", F.lit(True))
    texts = tokens.filter("chars is not null").select("host_key", "rid", "at", "tok", "unit", "named", "chars")
    texts = join_salted(texts, fixed, ["host_key", "tok"], "left").withColumn("slot", F.col("fixed").isNull() | (F.col("named") == 2))
    units = texts.groupBy("rid", "host_key", "unit", "named").agg(
        F.sum(F.when(F.col("slot"), F.col("chars")).otherwise(0)).alias("slot_chars"), F.sum("chars").alias("chars"),
        F.collect_list(F.when(F.col("slot"), F.col("at"))).alias("slots"), F.collect_list("at").alias("blocks"),
    )
    units = staged(units, "units")
    amounts = units.groupBy("host_key", "unit", "named").agg(F.avg("slot_chars").alias("amount"), F.avg("chars").alias("whole"))
    hosts = parsed.groupBy("host_key").agg(F.count("*").alias("pages"))
    amounts = staged(amounts.join(hosts, "host_key"), "amounts")
    return units, amounts


def main_text(pages: DataFrame) -> DataFrame:
    """page_id, url and the main text of every page, blocks joined by one space.

    Blocks that are no template text (see ``template_texts``) fill slots; a slot is a region path, with all
    that lies in it if its name says article or aside. Over the host, the slots' mean amounts of text say which slot of a page is the main
    one; names only break ties, that is, decide between amounts within a factor ``NEAR``, between slots on hosts
    of under ``LEAST_PAGES`` pages, and where a page has no slot left. Beside a main slot in an article only
    articles are kept, beside another all that is not aside by its name. Inside an article or main region a
    repeated text is content, as mirrored pages share it. Null and empty pages give an empty text. A null url is
    a host of its own; repeated rows give equal rows; other columns are not looked at.
    """
    host = F.coalesce(F.lower(F.regexp_extract(F.col("url"), r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)", 1)), F.lit(""))
    parsed = pages.select("page_id", "url", F.xxhash64(host).alias("host_key"), tokens_of(F.col("html")).alias("tokens"))
    parsed = staged(parsed.withColumn("rid", F.monotonically_increasing_id()), "tokens")
    with recording() as needed_until_here:
        units, amounts = slots_and_amounts(parsed)
    units = join_salted(units, amounts, ["host_key", "unit", "named"])
    on_page = F.array_sort(F.collect_list(F.struct("unit", "named", "amount", "whole", "pages", "slots", "blocks")))
    kept = units.groupBy("rid").agg(on_page.alias("units")).select("rid", chosen_places(F.col("units")).alias("kept"))
    kept = staged(kept, "kept")
    for path in needed_until_here:
        remove_path(pages.sparkSession, path)
    total = kept.agg(F.sum(16 + 4 * F.size("kept")).alias("bytes")).first()["bytes"] or 0
    # The places are small beside the texts: while they are few in all, the texts stay where they lie.
    places = F.broadcast(kept) if total <= MOST_BROADCAST else kept
    joined = parsed.select("page_id", "url", "rid", F.col("tokens.text").alias("texts")).join(places, "rid", "left")
    text = F.coalesce(F.array_join(F.transform("kept", lambda i: F.get("texts", i)), " "), F.lit(""))
    return joined.select("page_id", "url", text.alias("text")).withColumn("n_chars", F.length("text").cast("long"))
