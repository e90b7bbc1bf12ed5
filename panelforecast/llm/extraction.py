"""Main text of web pages by deducing the template that pages of a host share."""

from __future__ import annotations

import html
import re
from bisect import bisect_left
from collections import Counter, defaultdict

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from panelforecast.sources.stages import stage

GROUP_PAGES = 32
# share of a group's pages that a tag, and a text, of the template is on
SUPPORT = 0.6
TEXT_SUPPORT = 0.8
# fewer unlike pages have no texts in common that could be told from their articles
TEXT_PAGES = 3
# fixed values: elements by their role in the HTML standard
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
SILENT = frozenset("script style template noscript iframe svg math object canvas audio video head title select textarea button".split())
ASIDE = frozenset("nav header footer aside form menu dialog address".split())
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul".split()
)
CLOSED_BY_PARAGRAPH = frozenset("address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
MAIN = frozenset(("article", "main"))
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
PROSE = HEADINGS | frozenset("p li dt dd td th pre blockquote figcaption caption".split())
# words of class, id and role attributes that name what is not the article
NAMED_ASIDE = frozenset(
    "ad ads adv advert adverts advertisement advertising banner sponsor sponsored promo promotion cookie cookies consent notice notices gdpr popup modal "
    "overlay newsletter subscribe subscription signup login nav navbar navigation menu menubar breadcrumb breadcrumbs header masthead footer sidebar side "
    "aside related recommended share sharing social comment comments respond replies reply disqus pagination pager widget toolbar complementary contentinfo "
    "search skip".split()
)
# words that change nothing of such a name when they stand beside it
COMPANIONS = frozenset(
    "area articles bar block bottom box button buttons container content form group icons inner item items left links list outer panel post posts right section "
    "site slot stories thread top unit wrap wrapper".split()
)
_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<![^>]*>|<\?[^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>", re.S)
_ATTRIBUTE = re.compile(r"""(?:^|\s)(class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s>]+)""", re.I)
_RAW = {name: re.compile(rf"</{name}\s*>", re.I) for name in ("script", "style", "textarea", "title", "noscript", "iframe", "template")}
_SPACE = re.compile(r"[ \t\n\r\f\v\xa0]+")
_PARTS = re.compile(r"[-_:#]+")


class Page:
    """One page as a flat list of tokens: tags with their class, role and id words, and the text between them.

    Comments and the insides of raw elements are left out. Elements that the page does not
    close end with the element around them. Words of ids begin with ``#``.
    """

    def __init__(self, source: str):
        self.tokens: list[tuple[str, str, tuple[str, ...]]] = []  # ("<" or ">" or "text", name or text, words)
        stack: list[str] = []
        opened: Counter = Counter()
        at = 0

        def close(depth: int) -> None:
            while len(stack) > depth:
                opened[stack[-1]] -= 1
                self.tokens.append((">", stack.pop(), ()))

        while True:
            found = _TOKEN.search(source, at)
            text = source[at : found.start() if found else len(source)]
            if text:
                self.tokens.append(("text", text, ()))
            if not found:
                break
            at = found.end()
            name = (found[2] or "").lower()
            if not name:
                continue
            if found[1]:
                if opened[name]:
                    close(max(k for k in range(len(stack) - 1, -1, -1) if stack[k] == name))
                continue
            if opened["p"] and name in CLOSED_BY_PARAGRAPH:
                inner = len(stack) - 1
                while stack[inner] not in BLOCKS:
                    inner -= 1
                if stack[inner] == "p":
                    close(inner)
            if name in ("li", "td", "th", "tr", "dt", "dd", "option") and stack and stack[-1] == name:
                close(len(stack) - 1)
            words = set()
            for attribute, value in _ATTRIBUTE.findall(found[3]):
                words.update(("#" if attribute.lower() == "id" else "") + w for w in value.strip("\"'").lower().split())
            self.tokens.append(("<", name, tuple(sorted(words))))
            if name in VOID or found[3].endswith("/"):
                self.tokens.append((">", name, ()))
                continue
            stack.append(name)
            opened[name] += 1
            if name in _RAW:
                end = _RAW[name].search(source, at)
                at = end.end() if end else len(source)
                close(len(stack) - 1)
        close(0)


def set_aside(name: str, words: tuple[str, ...], in_main: bool) -> bool:
    """Whether an element names itself as something else than the article.

    Elements do so by their role in the standard; the header inside an article or main element is
    the article's own. Of class, id and role words one has to consist of listed words and their
    companions alone: ``ad-slot`` and ``related-posts`` do, ``side-note`` and ``related-work`` do not.
    Headings, and the ids of paragraphs, name places to link to, not roles.
    """
    if name in SILENT:
        return True
    if name in ASIDE:
        return not (in_main and name == "header")
    if name in HEADINGS or name in ("html", "body", "main"):
        return False
    for word in words:
        if name == "p" and word[0] == "#":
            continue
        parts = [w for w in _PARTS.split(word) if w and not w.isdigit()]
        listed = [w for w in parts if w in NAMED_ASIDE]
        if listed and all(w in NAMED_ASIDE or w in COMPANIONS for w in parts):
            if name == "article" and not any(w.startswith(("comment", "repl", "respond")) for w in listed):
                continue  # an article is one whatever it is styled as, but for readers' own
            if not (in_main and set(listed) == {"header"}):
                return True
    return False


class Group:
    """Pages of one host, their elements told apart by numbered paths of open elements.

    A step of a path is the element's name with those class, role and id words that most pages
    have on such an element, so that a word of one page does not part what is the same.
    ``walks`` hold a page's tokens as (kind, path, text, set aside, inside article or main).
    """

    def __init__(self, pages: list[Page]):
        on_pages = Counter(pair for page in pages for pair in {(name, w) for _, name, words in page.tokens for w in words})
        shared = {pair for pair, n in on_pages.items() if n >= SUPPORT * len(pages)}
        self.names, self.steps, self.parents, self.blocks = [""], [""], [0], [""]
        numbers: dict[tuple[int, str], int] = {}
        self.walks: list[list[tuple[str, int, str, bool, bool]]] = []
        for page in pages:
            walk, stack = [], [(0, False, False)]
            for kind, value, words in page.tokens:
                path, aside, in_main = stack[-1]
                if kind == "<":
                    step = ".".join([value, *[w for w in words if (value, w) in shared]])
                    parent, path = path, numbers.setdefault((path, step), len(self.names))
                    if path == len(self.names):
                        self.names.append(value)
                        self.steps.append(step)
                        self.parents.append(parent)
                        self.blocks.append(value if value in BLOCKS else self.blocks[parent])
                    aside = aside or set_aside(value, words, in_main)
                    in_main = in_main or value in MAIN
                    stack.append((path, aside, in_main))
                elif kind == ">":
                    stack.pop()
                walk.append((kind, path, value if kind == "text" else "", aside, in_main))
            self.walks.append(walk)
        self.sizes = [self._sizes(walk) for walk in self.walks]

    def _sizes(self, walk) -> dict[int, int]:
        """Characters of text in each path that are not set aside."""
        sizes: dict[int, int] = defaultdict(int)
        for kind, path, text, aside, _ in walk:
            if kind == "<":
                sizes[path] += 0
            elif kind == "text" and not aside:
                sizes[path] += len(text.strip())
        for path in sorted(sizes, reverse=True):  # a path has a higher number than the one around it
            if path:
                sizes[self.parents[path]] += sizes[path]
        return dict(sizes)

    def name_of(self, path: int) -> str:
        steps = []
        while path:
            steps.append("/" + self.steps[path])
            path = self.parents[path]
        return "".join(reversed(steps))

    def unlike(self) -> list[int]:
        """One page of each kind of article: copies of an article are no evidence of a template."""
        kept: dict[tuple, int] = {}
        for i, walk in enumerate(self.walks):
            own = tuple(_line(text) for kind, _, text, aside, in_main in walk if kind == "text" and in_main and not aside)
            rest = () if any(own) else tuple(_line(text) for kind, _, text, aside, _ in walk if kind == "text" and not aside)
            kept.setdefault((own, rest), i)
        return sorted(kept.values())


def _line(text: str) -> str:
    return _SPACE.sub(" ", text).strip()


def _in_order(sequences: list[list]) -> set:
    """The tokens that keep one order in all sequences, that of the first: those outside a
    longest common order on any page are left out."""
    place = {token: k for k, token in enumerate(sequences[0])}
    good = set(place)
    for sequence in sequences[1:]:
        ranks = [place[t] for t in sequence]
        ends, at, before = [], [], []
        for k, rank in enumerate(ranks):
            n = bisect_left(ends, rank)
            ends[n : n + 1] = [rank]
            at[n : n + 1] = [k]
            before.append(at[n - 1] if n else -1)
        kept, k = set(), at[-1] if at else -1
        while k >= 0:
            kept.add(sequence[k])
            k = before[k]
        good &= kept
    return good


def deduce(group: Group, pages: list[int], support: float = SUPPORT) -> tuple[set[int], set[tuple[int, str]]]:
    """(paths, texts) that belong to the template of ``pages`` of a group.

    Tokens are the opened paths and the texts in them. Those with equal vectors of occurrences over
    the pages form an equivalence class. A class counts if most pages have it; its tokens have to come
    in one order on all of them, others stand for themselves. A class lies in a slot of the
    template: the path around each of its tokens has to be accepted before. Texts have to be of a
    class that spans the page, with all elements around them once a page, on nearly all of at least
    ``TEXT_PAGES`` pages and in order. Paragraphs, headings, lists and cells inside an
    article or main element are the article's own, whatever they have in common.
    """
    vectors: dict[tuple, dict[int, int]] = defaultdict(dict)
    firsts: list[dict[tuple, int]] = []
    for i in pages:
        counts: Counter = Counter()
        first: dict[tuple, int] = {}
        for k, (kind, path, text, _, in_main) in enumerate(group.walks[i]):
            if kind == ">" or (kind == "text" and in_main and group.blocks[path] in PROSE):
                continue
            token = (path, _line(text) if kind == "text" else None)
            if token[1] == "":
                continue
            counts[token] += 1
            first.setdefault(token, k)
        firsts.append(first)
        for token, n in counts.items():
            vectors[token][i] = n
    classes: dict[tuple, list[tuple]] = defaultdict(list)
    for token, vector in vectors.items():
        if len(vector) >= support * len(pages):
            classes[tuple(sorted(vector.items()))].append(token)
    paths: set[int] = {0}
    spanning: set[int] = {0}
    found: set[tuple[int, str]] = set()
    for vector, tokens in classes.items():
        on = {i for i, _ in vector}
        ordered = _in_order([sorted(tokens, key=firsts[k].__getitem__) for k, i in enumerate(pages) if i in on])
        once = all(n == 1 for _, n in vector)
        for token in tokens:
            if token[1] is None:
                paths.add(token[0])
                if once:
                    spanning.add(token[0])
            elif once and token in ordered and len(pages) >= TEXT_PAGES and len(on) >= TEXT_SUPPORT * len(pages):
                found.add(token)
    for path in sorted(paths):  # a path has a higher number than the one around it
        if group.parents[path] not in paths:
            paths.discard(path)
        if path not in paths or group.parents[path] not in spanning:
            spanning.discard(path)
    return paths, {token for token in found if token[0] in spanning}


def template_of(pages: list[Page], support: float = SUPPORT) -> set[str]:
    """The paths of the template of a group of pages, written out; the page itself is the empty one."""
    group = Group(pages)
    return {group.name_of(p) for p in deduce(group, list(range(len(pages))), support)[0]}


def _marked(group: Group, sizes: dict[int, int]) -> int | None:
    """The article element of the most text, else the main element of the most; a main element whose
    text lies mostly outside of articles is preferred to them."""
    best = {name: max((p for p in sizes if group.names[p] == name and sizes[p]), key=lambda p: (sizes[p], -p), default=None) for name in MAIN}
    if best["main"] is None or best["article"] is None:
        return best["article"] if best["main"] is None else best["main"]
    return best["article"] if 2 * sizes[best["article"]] >= sizes[best["main"]] else best["main"]


def main_slots(group: Group, template: set[int]) -> list[int]:
    """For each page the path whose slots hold the article.

    That is the template's article or main element; on a page without it its own one; and
    without any the template's deepest element that keeps most of the group's text, where
    the page has it, else the page.
    """
    total: Counter = Counter()
    for sizes in group.sizes:
        total.update(sizes)
    common = _marked(group, {p: n for p, n in total.items() if p in template})
    most = 0
    for path in sorted(template):
        if total[path] >= 0.9 * total[0] and group.parents[path] == most:
            most = path
    slots = []
    for sizes in group.sizes:
        own = common if common is not None and sizes.get(common) else _marked(group, sizes)
        slots.append(own if own is not None else most if sizes.get(most) else 0)
    return slots


def main_text(group: Group, index: int, slot: int, texts: set[tuple[int, str]]) -> str:
    """Text of a page in its main slot without what is set aside or a text of the template, blocks on
    lines of their own. First headings of the main element around an article are the article's.

    A page most of whose slot would be the template's (over two thirds) is a copy of other pages'
    articles, no template, and keeps its texts.
    """
    kept = dropped = 0
    blocks, parts = [], []
    stack = [slot == 0]

    def end_block() -> None:
        line = _SPACE.sub(" ", html.unescape("".join(parts))).strip()
        parts.clear()
        if line:
            blocks.append(line)

    for kind, path, text, aside, in_main in group.walks[index]:
        if kind == "text":
            if stack[-1] and not aside:
                line = _line(text)
                if line and (path, line) in texts:
                    dropped += len(line)
                    parts.append(" ")
                else:
                    kept += len(line)
                    parts.append(text)
            continue
        name = group.names[path]
        if name in BLOCKS:
            end_block()
        elif name == "br":
            parts.append(" ")
        if kind == "<":
            stack.append(stack[-1] or path == slot or (name == "h1" and in_main and slot != 0))
        else:
            stack.pop()
    end_block()
    if dropped > 2 * kept:
        return main_text(group, index, slot, set())
    return "\n".join(blocks)


def texts_of(sources: list[str]) -> list[str]:
    """Main texts of a group of pages of one host."""
    group = Group([Page(s) for s in sources])
    paths, texts = deduce(group, group.unlike())
    return [main_text(group, i, slot, texts) for i, slot in enumerate(main_slots(group, paths))]


def extract(pages: DataFrame, id_column: str = "page_id", url_column: str = "url", html_column: str = "html", group_pages: int = GROUP_PAGES) -> DataFrame:
    """``(id, url, text, n_chars)``, one row per page.

    Pages of a host are cut into groups of about ``group_pages`` by a hash of their id and
    source, so that a host of any size is many small pieces of work. In every group the
    template is deduced, and the text of its main slot is taken from each page: whole but for
    the template's own texts, with references decoded, white space inside a block as one space and
    blocks joined by line breaks. Pages without a host, and those of a host with few unlike pages, are
    judged by their own elements. A null or empty source has an empty text. Repeated rows stay.
    """
    rows = pages.select(
        F.col(id_column).cast("long").alias("id"), F.col(url_column).cast("string").alias("url"), F.coalesce(F.col(html_column).cast("string"), F.lit("")).alias("html")
    )
    host = F.coalesce(F.lower(F.regexp_extract("url", r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]+)", 1)), F.lit(""))
    rows = rows.withColumn("host", host)
    sizes = stage(rows.groupBy("host").agg(F.ceil(F.count(F.lit(1)) / group_pages).cast("int").alias("groups")), "host-groups")
    grouped = rows.join(sizes, "host").withColumn("part", F.pmod(F.xxhash64("id", "url"), F.col("groups")).cast("int"))

    def work(group: pd.DataFrame) -> pd.DataFrame:
        sources = group["html"].tolist()
        texts = texts_of(sources) if group["host"].iloc[0] else [texts_of([s])[0] for s in sources]
        return pd.DataFrame({"id": group["id"], "url": group["url"], "text": texts, "n_chars": [len(t) for t in texts]})

    done = grouped.select("id", "url", "html", "host", "part").groupBy("host", "part").applyInPandas(work, "id long, url string, text string, n_chars long")
    return done.select(F.col("id").alias(id_column), F.col("url").alias(url_column), "text", "n_chars")
