"""Main text of web pages by two passes over blocks.

Pass one labels a block by where it stands (menus, footers, adverts and the like are bad), its length, link density and density of
stop words; pass two gives every block still open the label of its nearest decided neighbour.  Stop words are those of four languages: where
they find no good block, sentences do.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reeltally.llm.registry import query, table

SHORT_CHARS = 70
LINKS_BAD, LINKS_SHORT_BAD = 0.5, 0.2
STOPS_GOOD = 0.25
DENSE_CHARS = 25  # length of a block in a script that sets no spaces between words
LINK_RUN = 3  # so many blocks of links in a row are a menu, in an article, too

# Elements of the HTML standard, and frequent words of four languages.
BLOCK_TAGS = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6"
    " header hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul".split()
)
VOID_TAGS = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW_TAGS = frozenset("script style textarea title iframe xmp noembed noframes".split())  # their content has no tags
DROPPED_TAGS = frozenset("svg math object canvas audio video select button map noscript template".split())
HEAD_TAGS = RAW_TAGS - {"textarea", "iframe", "xmp", "noembed"} | {"html", "head", "base", "basefont", "bgsound", "link", "meta", "noscript", "template"}
BAD_TAGS = frozenset("nav footer aside form menu dialog".split())
BAD_ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert menu menubar form".split())
BAD_NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertisements adbox banner sponsor sponsored promo promotion menu nav navbar navigation breadcrumb"
    " breadcrumbs sidebar footer masthead cookie cookies consent gdpr notice notices popup modal overlay comment comments disqus respond replies"
    " related share sharing social subscribe newsletter signup login widget pagination pager toolbar".split()
)
# Words that a name may hold beside a bad one and still mean the same: a share bar, a list of comments.
NEUTRAL_NAMES = frozenset(
    "area articles bar block body bottom box btn button buttons container content count fixed footer form global group header icon icons inline inner item items"
    " left link links list lower main mobile module news outer page panel posts primary right row secondary section side site slot stories tools top"
    " unit upper wrap wrapper".split()
)
STOP_WORDS = frozenset(
    "the of and to in is that for with on was it as are by an be this from at or not have has but they his her you we"
    " der die das und ist in von zu den mit für auf nicht ein eine als auch es an dem des sich im dass er sie wie bei"
    " le la les de du des et un une est que qui dans pour par sur avec pas au aux ce il elle en ne se plus son sa"
    " el los las del y en es que por con para una un no se lo su al como más pero sus le este".split()
)

TAG = re.compile(
    r"<!--(?:.*?-->|.*\Z)"  # comment
    r"|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?>[^\"'>]+|\"[^\"]*\"|'[^']*')*+|[^>]*+)/?>"  # tag
    r"|<[!?/][^>]*>",  # doctype, instruction, stray end
    re.S,
)
ATTRIBUTE = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
RAW_OR_DROPPED = re.compile(rf"<!--.*?-->|<(/?)({'|'.join(sorted(RAW_TAGS | DROPPED_TAGS))})(?![a-zA-Z0-9:-])((?>[^\"'>]+|\"[^\"]*\"|'[^']*')*+|[^>]*+)>", re.S | re.I)
RAW_ENDS = {tag: re.compile(rf"</{tag}\b[^>]*>", re.I) for tag in RAW_TAGS | {"head"}}
NOSCRIPT = re.compile(r"<(/?)noscript\b[^>]*>", re.I)
FOREIGN_END = re.compile(r"</(?:svg|math)\b", re.I)
NAME_PARTS = re.compile(r"[a-z]+")
SENTENCE = re.compile(r"[.!?\u2026\u0589\u061f\u06d4\u0964\u104b\u1362\u17d4]['\"\u00bb\u2019\u201d)\]]*(?:\s|\Z)|[\u3002\uff01\uff1f\uff0e]")


@dataclass
class Block:
    text: str
    links: int  # characters inside links
    region: int  # which article or main part it stands in; 0: none
    bad_place: bool
    good: bool | None = None


def bad_name(token: str, inside: bool) -> bool:
    """A class or id that names a menu, an advert and the like.

    Outside any article its first or last part may do so (``site-footer``, ``cookie-bar-2``); inside one all parts must, so that
    ``share-price`` or ``related-work`` are content.
    """
    words = NAME_PARTS.findall(token)
    if not BAD_NAMES.intersection(words):
        return False
    return all(w in BAD_NAMES or w in NEUTRAL_NAMES for w in words) or not inside and (words[0] in BAD_NAMES or words[-1] in BAD_NAMES)


def bad_place(tag: str, attributes: str, region: int) -> bool:
    if tag in BAD_TAGS or (tag == "header" and not region):
        return True
    if not attributes or tag in ("html", "body", "main", "article"):
        return False
    for name, *values in ATTRIBUTE.findall(attributes):
        value = "".join(values).lower()
        if name.lower() == "role":
            if BAD_ROLES.intersection(NAME_PARTS.findall(value)):
                return True
        elif any(bad_name(token, region > 0) for token in value.split()):
            return True
    return False


def raw_end(page: str, tag: str, at: int) -> int | None:
    close = RAW_ENDS[tag].search(page, at)
    return close.end() if close else None


def dropped_ends(page: str) -> dict[int, int]:
    """Where the content of dropped tags begins and, behind their own end tags, ends; tags without one are left out."""
    out: dict[int, int] = {}
    begun: dict[str, list[int]] = {tag: [] for tag in DROPPED_TAGS}
    endless: set[str] = set()
    at = 0
    while match := RAW_OR_DROPPED.search(page, at):
        at = match.end()
        if match[2] is None:
            continue
        tag = match[2].lower()
        if match[1]:
            if tag in DROPPED_TAGS and begun[tag]:
                out[begun[tag].pop()] = at
        elif match[0].endswith("/>"):
            continue
        elif tag == "noscript":  # cannot hold another one
            close = NOSCRIPT.search(page, at)
            if close and close[1]:
                out[at] = at = close.end()
        elif tag in DROPPED_TAGS:
            begun[tag].append(at)
        elif tag not in endless:
            close = RAW_ENDS[tag].search(page, at)
            if not close:
                endless.add(tag)
            elif not ((begun["svg"] or begun["math"]) and FOREIGN_END.search(page, at, close.start())):
                at = close.end()
    return out


def head_end(page: str, at: int, ends: dict[int, int]) -> int:
    """The head ends behind its end tag, or before the first text or tag that cannot stand in it."""
    while match := TAG.search(page, at):
        if not page[at : match.start()].isspace() and match.start() > at:
            return at
        at = match.end()
        if match[2] is None:
            continue
        tag = match[2].lower()
        if match[1]:
            if tag == "head":
                return at
            if tag in ("body", "html", "br"):
                return match.start()
        elif tag not in HEAD_TAGS:
            return match.start()
        elif match[0].endswith("/>"):
            continue
        elif tag in RAW_TAGS:
            close = raw_end(page, tag, at)
            end = raw_end(page, "head", at) if close is None or tag != "script" else None
            # A title or style sheet that would run over the head's end tag has none of its own.
            if close is None or end is not None and end < close:
                return end or len(page)
            at = close
        elif at in ends:
            at = ends[at]
    return at


def blocks_of(page: str) -> list[Block]:
    """The page's blocks in order, with white space made single and character references decoded.

    A dropped tag without an end tag ends before the next block tag, or with what it stands in.  A raw one runs to the page's end.
    """
    out: list[Block] = []
    parts: list[str] = []
    link_parts: list[str] = []
    open_tags: list[tuple[str, bool, int, bool]] = []  # tag, bad place, region, link
    bad, region, link, regions = False, 0, False, 0
    ends = dropped_ends(page)
    endless, depth = "", 0  # a dropped tag without an end tag, and how many tags were open around it

    def add(chunk: str) -> None:
        if endless:
            return
        parts.append(chunk)
        if link:
            link_parts.append(chunk)

    def end_block() -> None:
        if parts:
            text = " ".join(html.unescape("".join(parts)).split())
            if text:
                out.append(Block(text, len(" ".join(html.unescape("".join(link_parts)).split())), region, bad))
            parts.clear()
            link_parts.clear()

    at = 0
    while match := TAG.search(page, at):
        if match.start() > at:
            add(page[at : match.start()])
        at = match.end()
        if match[2] is None:
            continue
        tag = match[2].lower()
        if (tag in BLOCK_TAGS or tag == "head") and not (endless == "select" and tag in ("option", "hr")):
            end_block()
            endless = ""
        elif tag == "br":
            add(" ")
        if match[1]:  # an end tag closes what is open inside it; a stray one closes nothing
            for i in range(len(open_tags) - 1, -1, -1):
                if open_tags[i][0] == tag:
                    _, bad, region, link = open_tags[i]
                    del open_tags[i:]
                    if i < depth:
                        endless = ""
                    break
        elif tag == "head":
            at = head_end(page, at, ends)
        elif tag in RAW_TAGS and not match[0].endswith("/>"):
            at = raw_end(page, tag, at) or len(page)
        elif tag in DROPPED_TAGS and not match[0].endswith("/>"):
            if at in ends:
                at = ends[at]
            elif not endless:
                endless, depth = tag, len(open_tags)
        elif tag not in VOID_TAGS:
            open_tags.append((tag, bad, region, link))
            if tag in ("article", "main") and not (region or bad):
                regions += 1
                region = regions
            bad = bad or bad_place(tag, match[3] or "", region)
            link = link or tag == "a"
    add(page[at:])
    end_block()
    return out


def label(block: Block) -> bool | None:
    """Pass one: True good, False bad, None open."""
    if block.bad_place:
        return False
    density = block.links / len(block.text)
    if density > (LINKS_SHORT_BAD if len(block.text) < SHORT_CHARS else LINKS_BAD):
        return False
    if len(block.text) < SHORT_CHARS:
        return None
    words = block.text.lower().split()
    stops = sum(word.strip(".,;:!?") in STOP_WORDS for word in words) / len(words)
    return True if stops >= STOPS_GOOD else None


def sentences(block: Block, short: bool) -> bool:
    """Text outside links that reads like sentences, whatever its language; long enough for it unless ``short``."""
    if block.bad_place or block.links / len(block.text) > LINKS_SHORT_BAD or not SENTENCE.search(block.text):
        return False
    spaced = len(block.text.split()) * 2 * DENSE_CHARS >= len(block.text)
    return short or len(block.text) >= (SHORT_CHARS if spaced else DENSE_CHARS)


def settle(blocks: list[Block]) -> None:
    """Pass two.  Neighbours are the blocks of the same article, or of the page outside any; blocks in a bad place neither
    ask nor answer there.  At equal distance good wins.  With no decided neighbour an article's block is good, any other bad.

    Before that, a block of links in an article is open again unless it is one of ``LINK_RUN`` or more in a row.  An article, or a page, without a
    good block takes those with sentences for good, long ones or else any.
    """
    for block in blocks:
        block.good = label(block)
    rows = {region: [b for b in blocks if b.region == region and not (b.bad_place and region)] for region in {b.region for b in blocks}}
    for region, row in rows.items():
        run: list[Block] = []
        for block in [*row, None] if region else ():
            if block is not None and block.good is False:
                run.append(block)
                continue
            for one in run if len(run) < LINK_RUN else ():
                one.good = None
            run = []
    # Articles first: the page outside them is asked only where they hold nothing.
    for region in sorted(rows, reverse=True):
        if not any(b.good for b in (rows[region] if region else blocks)):
            for short in (False, True):
                found = [b for b in rows[region] if b.good is None and sentences(b, short)]
                for block in found:
                    block.good = True
                if found:
                    break
    for region, row in rows.items():
        decided = [i for i, b in enumerate(row) if b.good is not None]
        before, k = None, 0
        for i, block in enumerate(row):
            while k < len(decided) and decided[k] < i:
                before, k = decided[k], k + 1
            if block.good is not None:
                continue
            after = decided[k] if k < len(decided) else None
            if before is None and after is None:
                block.good = region > 0
            elif after is None or before is not None and i - before < after - i:
                block.good = row[before].good
            elif before is None or after - i < i - before:
                block.good = row[after].good
            else:
                block.good = row[before].good or row[after].good


def main_text(page: str) -> str:
    blocks = blocks_of(page)
    settle(blocks)
    return "\n\n".join(b.text for b in blocks if b.good)


def extract_main_text(pages: DataFrame, *, id_col: str = "page_id", html_col: str = "html", keep: tuple[str, ...] = ("url",)) -> DataFrame:
    """``id``, the columns of ``keep`` (strings), ``text`` and ``n_chars`` (its code points) of every whole page.

    One row for each row, in place, without a shuffle.  Null and empty pages give an empty text; so do pages without
    a good block.  Ids and kept columns may be null; repeated rows give repeated rows; other columns are ignored; an
    empty table gives no rows.  A page is one row's work; time grows with its length.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            batch["__text"] = [main_text(page or "") for page in batch.pop("__html")]
            batch["__n"] = batch["__text"].str.len().astype("int64")
            yield batch

    kinds = [(c, pages.schema[c].dataType.simpleString()) for c in (id_col, *keep)]
    names = [f"__{i}" for i in range(len(kinds))]
    source = pages.select(*[F.col(c).cast("string").alias(n) for n, (c, _) in zip(names, kinds)], F.col(html_col).cast("string").alias("__html"))
    out = source.mapInPandas(run, ", ".join(f"{n} string" for n in names) + ", __text string, __n long")
    shown = [F.col(n).cast(kind).alias("id" if i == 0 else c) for i, (n, (c, kind)) in enumerate(zip(names, kinds))]
    return out.select(*shown, F.col("__text").alias("text"), F.col("__n").alias("n_chars"))


@query("op5_html_text")
def op5_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_main_text(table(spark, sf_dir, "pages")).withColumnRenamed("id", "page_id")
