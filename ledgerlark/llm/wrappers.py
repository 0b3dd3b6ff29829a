"""Main text of web pages by wrappers inferred for each host.

A wrapper is a union-free regular expression over the block tags and texts of a
host's pages: elements, optional and repeated groups, and text slots. It starts as
one page's tags and is aligned with the next page's again and again; what only one
side has becomes optional, neighbours that repeat become a repeated group, texts
become slots. A slot keeps the hashes of the texts that it shows on every page so far,
so what one page lacks is fixed no more.

Regions are chosen on the wrapper of a host with FIXED_PAGES pages or more, by the text
that varies over its pages: article and main elements are the main text if they hold at
least half of it, else the body is; forms and regions of doubtful class names go unless
they hold most of it; texts that a slot shows on all pages go. Tag and class names are
the prior: menus, headers, footers, sidebars, notices, adverts and comments go, and on
hosts with fewer pages names and the page's own text decide alone. A page is then read
along its wrapper and yields the texts of the regions that stay.

Each task folds its pages into one wrapper a host before anything is shuffled, and
wrappers are merged in two steps, so a host with a third of all pages meets in a
task only as a few wrappers.
"""

import functools
import hashlib
import html
import json
import re
from collections import Counter

from pyspark.sql import functions as F

from ledgerlark.llm.common import arrow_schema, batch_of_rows, lists
from ledgerlark.plans import lineage

#: Elements nested deeper are read as part of their parent, but for articles and regions that
#: go, at most three levels more; longer lists of children, and larger alignments, become one
#: repeated group of optional elements.
DEEPEST, CHILDREN, CELLS = 48, 64, 40_000
#: Neighbours of one symbol that repeat whatever their shape.
ALIKE = 4
#: Pages of a host before its wrapper decides what is template and what is main text.
FIXED_PAGES = 4
#: Wrappers held in a task before they are passed on.
HOSTS = 4096
_SALTS = 32

_TOKEN = re.compile(
    r"""<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(?P<end>/?)(?P<name>[a-zA-Z][^\s/<>]*)(?P<attributes>(?>[^<>"']|"[^"<]*"|'[^'<]*'|["'])*+)>""",
    re.DOTALL,
)
_ATTRIBUTE = re.compile(r"""([a-zA-Z_:][-\w:.]*)\s*(?:=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_WORD = re.compile(r"[a-z]+")
_RAW = {name: re.compile(f"</{name}(?=[\\s/>])", re.IGNORECASE) for name in "script style title textarea noscript iframe xmp noembed noframes template".split()}
_VOID = set("area base br col embed hr img input link meta param source track wbr".split())
_INLINE = set("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q ruby rt rp s samp small span strike strong sub sup time tt u var wbr".split())
#: Elements that an opening tag ends, up to the container that keeps them open.
_ENDS = {"li": "li", "dt": "dt dd", "dd": "dt dd", "tr": "tr td th", "td": "td th", "th": "td th", "option": "option", "tbody": "tr td th thead tbody", "tfoot": "tr td th tbody"}
_KEEPS = set("ul ol dl table".split())
_ENDS_P = set(
    "address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul body html".split()
)
_GONE = set("head nav footer aside form button select menu dialog svg canvas object audio video applet map datalist".split())
_GONE_WORDS = set(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion cookie cookies consent gdpr notice popup modal overlay newsletter subscribe signup "
    "nav navbar navigation menu breadcrumb breadcrumbs footer sidebar widget related recommended share sharing social comment comments disqus respond reply replies form login "
    "search pagination pager".split()
)
_GONE_OUTSIDE = set("header banner masthead toolbar topbar side aside copyright legal skip".split())
_GONE_ROLES = set("navigation banner contentinfo complementary search dialog alert alertdialog form menu menubar toolbar".split())
_MAIN_WORDS = set("articlebody".split())
#: A class or id with one of these pieces says what a page has or is, not what a region is.
_SAYS = set("has have no not without with is hide show page layout template enabled disabled active open".split())
#: Texts of an article that a class or id does not make a region: paragraphs go only by a class of
#: _NEVER, headings and cells never.
_HEADINGS = set("h1 h2 h3 h4 h5 h6 td th caption figcaption".split())
_TEXTS = _HEADINGS | {"p"}
#: What else the id of a region inside an article may say; other words make it the slug of a heading.
_REGION_WORDS = set("section list area thread box block wrap wrapper container form content holder panel body post article page site title count main top bottom left right js id".split())
#: Regions that go however much they hold, if their class or id has such a piece.
_NEVER = set("comment comments disqus respond reply replies ad ads adv advert adverts advertisement advertising sponsor sponsored cookie cookies".split())


def _symbol(name, attributes):
    """An element's name with its role, its id and the words of its class, each with its
    hyphens, numbers left out."""
    words = set()
    for key, *values in _ATTRIBUTE.findall(attributes):
        if key.lower() in ("class", "id", "role", "itemprop"):
            value = "".join(values).lower()
            sign = {"role": "role=", "id": "id="}.get(key.lower(), "")
            words.update(sign + (word if sign == "role=" else own) for word in value.split() if (own := "-".join(_WORD.findall(word))) or sign == "role=")
    return " ".join([name, *sorted(words - {""})])


def parse(page):
    """The page as a tree of block elements: [symbol, children], texts as strings. Inline
    tags vanish, line breaks are white space, unclosed elements end where they must."""
    root = ["#page", []]
    # every open element has an entry; one below DEEPEST shares its parent's node
    open_nodes, names, pieces, at = [root], ["#page"], [], 0
    # nodes above an element, articles above it, and below DEEPEST: 1 in a region that goes,
    # 2 in an article, 3 in a region that goes there
    states, counts = [(1, 0, 0)], Counter()

    def flush():
        if pieces:
            words = html.unescape("".join(pieces)).split()
            pieces.clear()
            if words:
                open_nodes[-1][1].append(" ".join(words))

    def close(name):
        flush()
        while True:
            counts[names[-1]] -= 1
            ended = names.pop()
            del open_nodes[-1], states[-1]
            if ended == name:
                break

    while True:
        found = _TOKEN.search(page, at)
        if not found:
            pieces.append(page[at:])
            break
        pieces.append(page[at : found.start()])
        at, name = found.end(), found["name"]
        if name is None:
            continue
        name = name.lower()
        if name in _RAW and not found["end"]:
            end = _RAW[name].search(page, at)
            at = page.find(">", end.end()) + 1 if end else 0
            at = at or len(page)
            pieces.append(" ")
        elif name in _INLINE:
            continue
        elif name in _VOID:
            pieces.append(" ")
        elif found["end"]:
            if counts[name]:
                close(name)
            pieces.append(" ")
        else:
            if name in _ENDS_P and counts["p"]:
                close("p")
            ends = _ENDS.get(name, "").split()
            for k in range(len(names) - 1, 0, -1) if any(counts[end] for end in ends) else ():
                if names[k] in _KEEPS:
                    break
                if names[k] in ends:
                    close(names[k])
                    break
            flush()
            symbol = _symbol(name, found["attributes"])
            depth, articles, deep = states[-1]
            node, gone = open_nodes[-1], _gone(symbol, articles > 0)
            own = deep
            if depth >= DEEPEST:
                own = deep + 1 if gone and deep in (0, 2) else 2 if not gone and _main(symbol) and deep < 2 else deep
            if depth < DEEPEST or own != deep:
                node = [symbol, []]
                open_nodes[-1][1].append(node)
                depth += 1
            open_nodes.append(node)
            names.append(name)
            states.append((depth, articles + (not gone and _main(symbol)), own))
            counts[name] += 1
    flush()
    return root


@functools.lru_cache(maxsize=100_000)
def _gone(symbol, inside):
    """Whether a region isn't main text: 0 if it is, 2 if it isn't, 1 if it isn't unless it
    holds most text, as forms around a page do; ``inside``: it lies in the article."""
    name, *words = symbol.split(" ")
    roles = {word[5:] for word in words if word.startswith("role=")}
    ids = {word[3:] for word in words if word.startswith("id=")}
    words = {word for word in words if not word.startswith(("role=", "id="))}
    if inside and name in _TEXTS:
        return 2 * bool(words & _NEVER and name not in _HEADINGS)
    if inside:
        # headings lend their words to the ids of sections
        ids = {word for word in ids if set(word.split("-")) <= _GONE_WORDS | _REGION_WORDS}
    words |= ids
    pieces = set().union(*(own for word in words if not (own := set(word.split("-"))) & _SAYS))
    if name in ("html", "body", "article", "main"):
        return 2 * bool(pieces & {"comment", "comments", "reply", "advert", "ad"} and name == "article")
    listed = _GONE_WORDS if inside else _GONE_WORDS | _GONE_OUTSIDE
    if (name in _GONE and name != "form") or (name == "header" and not inside) or words & listed or roles & _GONE_ROLES or pieces & _NEVER:
        return 2
    return int(name == "form" or bool(pieces & listed))


def _main(symbol):
    name, *words = symbol.split(" ")
    return name in ("article", "main") or "role=main" in words or "role=article" in words or bool(_MAIN_WORDS & {word.removeprefix("id=") for word in words})


def _size(node, inside):
    """Characters of a region, without what goes in it whatever it holds."""
    return sum(len(child) if isinstance(child, str) else _size(child, inside or _main(child[0])) for child in node[1] if isinstance(child, str) or _gone(child[0], inside) < 2)


# A wrapper is [symbol, optional, repeated, children]; a text is ["#", optional, repeated,
# hashes of the texts that it shows on every page, characters on all pages]; a group of
# neighbours is ["(symbols)", ...] like an element.


def _hash(text):
    """A text's length and a hash of all of it."""
    return f"{len(text)}-{hashlib.blake2b(text.encode('utf-8', 'replace'), digest_size=8).hexdigest()}"


def wrapper_of(node):
    """A page's tree as the wrapper that fits it alone, repetitions folded."""
    children = [["#", 0, 0, [_hash(child)], len(child)] if isinstance(child, str) else wrapper_of(child) for child in node[1]]
    return [node[0], 0, 0, _folded(children)]


def _shape(item):
    """An item's symbols, without texts."""
    return item[0] if item[0] == "#" or not item[3] else f"{item[0]}[{','.join(map(_shape, item[3]))}]"


def _folded(items):
    """Neighbours that repeat, alone or in twos and threes, become one repeated group: two
    or three of equal shape, more of equal symbols."""
    for period in (1, 2, 3):
        done, at = [], 0
        while at < len(items):
            shape = [item[0] for item in items[at : at + period]]
            stop = at + period
            while len(shape) == period and [item[0] for item in items[stop : stop + period]] == shape:
                stop += period
            few = stop - at < ALIKE * period and len({tuple(map(_shape, items[k : k + period])) for k in range(at, stop, period)}) > 1
            if stop - at <= period or few or (period > 1 and len(set(shape)) == 1):
                done.append(items[at])
                at += 1
                continue
            whole = items[at : at + period]
            for k in range(at + period, stop, period):
                whole = [_merged(a, b) for a, b in zip(whole, items[k : k + period])]
            if period == 1:
                done.append([whole[0][0], whole[0][1], 1, whole[0][3]])
            else:
                done.append([f"({','.join(shape)})", 0, 1, whole])
            at = stop
        items = done
    return _grouped(items) if len(items) > CHILDREN else items


def _kinds(items):
    """One item for every symbol in a list, groups taken apart."""
    kinds = {}
    for item in items:
        for own in item[3] if item[0].startswith("(") else [item]:
            kinds[own[0]] = _merged(kinds[own[0]], own) if own[0] in kinds else own
    return kinds


def _grouped(items, others=None):
    """Every kind of element that a long irregular list has, optional, in one repeated
    group; ``others`` are the list of other pages."""
    kinds = _kinds(items)
    if others is not None:
        left, right = kinds, _kinds(others)
        kinds = {k: _merged(left[k], right[k], True) if k in left and k in right else _lacking((left.get(k) or right[k])) for k in left | right}
    return [["(*)", 0, 1, [[kind[0], 1, 1, *kind[3:]] for _, kind in sorted(kinds.items())]]]


def _merged(a, b, pages=False):
    """The wrapper of two elements, groups or texts of one symbol: neighbours on the same
    pages, or with ``pages`` from different ones, where only what both show is fixed."""
    optional, repeated = a[1] | b[1], a[2] | b[2]
    if a[0] == "#":
        return ["#", optional, repeated, sorted(set(a[3]) & set(b[3]) if pages else set(a[3]) | set(b[3])), a[4] + b[4]]
    return [a[0], optional, repeated, _aligned(a[3], b[3], pages)]


def _lacking(item):
    """An item that some pages do not have: nothing in it is fixed."""
    if item[0] == "#":
        return ["#", *item[1:3], [], *item[4:]]
    return [*item[:3], [_lacking(child) for child in item[3]]]


def _hashes(item):
    return set(item[3]) if item[0] == "#" else set().union(*map(_hashes, item[3]))


def _runs(items, others):
    """Neighbours that repeat in ``others`` as one repeated item."""
    repeat, done = {item[0] for item in others if item[2]}, []
    for item in items:
        if done and done[-1][0] == item[0] and item[0] in repeat:
            both = _merged(done[-1], item)
            done[-1] = [both[0], both[1], 1, *both[3:]]
        else:
            done.append(item)
    return done


def _aligned(left, right, pages):
    """Two lists of children as one: common symbols in order are merged, most with common
    texts, others optional."""
    left, right = _runs(left, right), _runs(right, left)
    n, m = len(left), len(right)
    if any(item[0] == "(*)" for item in left + right) or n * m > CELLS:
        return _grouped(left, right) if pages else _grouped(left + right)
    names, others = [item[0] for item in left], [item[0] for item in right]
    if names == others:
        return _folded([_merged(a, b, pages) for a, b in zip(left, right)])
    # a common text decides only between alignments of as many symbols
    whole, texts = n + m, [list(map(_hashes, items)) for items in (left, right)]
    best = [[0] * (m + 1) for _ in range(n + 1)]
    for i in range(n - 1, -1, -1):
        row, below, symbol, own = best[i], best[i + 1], names[i], texts[0][i]
        for j in range(m - 1, -1, -1):
            row[j] = max(below[j], row[j + 1])
            if symbol == others[j]:
                row[j] = max(row[j], below[j + 1] + whole + (not own.isdisjoint(texts[1][j])))
    one = _lacking if pages else list
    items, i, j = [], 0, 0
    while i < n or j < m:
        if i < n and j < m and names[i] == others[j] and best[i][j] == best[i + 1][j + 1] + whole + (not texts[0][i].isdisjoint(texts[1][j])):
            items.append(_merged(left[i], right[j], pages))
            i, j = i + 1, j + 1
        elif j == m or (i < n and best[i + 1][j] >= best[i][j + 1]):
            own = one(left[i])
            items.append([own[0], 1, *own[2:]])
            i += 1
        else:
            own = one(right[j])
            items.append([own[0], 1, *own[2:]])
            j += 1
    return _folded(items)


def merge(a, b):
    """The wrapper that fits what either fits, of different pages."""
    return _merged(a, b, True)


def expression(wrapper):
    """A wrapper as a regular expression over tags, for people to read."""
    symbol, optional, repeated, inner, *_ = wrapper
    if symbol == "#":
        text = "#fixed" if inner else "#text"
    else:
        text = " ".join(map(expression, inner))
        text = text if symbol.startswith("(") else f"<{symbol}> {text} </{symbol.split(' ')[0]}>"
    sign = {(0, 0): "", (1, 0): "?", (0, 1): "+", (1, 1): "*"}[optional, repeated]
    return f"({text}){sign}" if sign else text


class _Region:
    """A wrapper's items of one symbol in one place: what they hold, by symbol, the hashes
    of the texts that all ``pages`` show there, and the characters that vary, without what
    goes whatever it holds."""

    def __init__(self, items=(), pages=1):
        self.kids, self.fixed, self.size = {}, set(), 0
        self._add(items)
        self._weigh(pages, False)

    def _add(self, items):
        for item in items:
            if item[0] == "#":
                self.fixed.update(item[3])
                self.size += item[4]
            elif item[0].startswith("("):
                self._add(item[3])
            else:
                if item[0] not in self.kids:
                    self.kids[item[0]] = _Region()
                self.kids[item[0]]._add(item[3])

    def _weigh(self, pages, inside):
        varies = max(0, self.size - pages * sum(int(key.split("-")[0]) for key in self.fixed))
        for symbol, kid in self.kids.items():
            kid._weigh(pages, inside or _main(symbol))
            varies += kid.varies if _gone(symbol, inside) < 2 else 0
        self.varies = varies

    def mains(self, whole):
        """The varying characters of article and main elements, and of all that stays."""
        inside, total = 0, self.varies
        for symbol, kid in self.kids.items():
            if not _stays(symbol, None, kid, False, whole):
                total -= kid.varies if _gone(symbol, False) < 2 else 0
            elif _main(symbol):
                inside += kid.varies
            else:
                part, rest = kid.mains(whole)
                inside, total = inside + part, total - kid.varies + rest
        return inside, total


def _whole(node, region, inside, pages):
    """What a region is compared with: varying characters of the wrapper, or the page's own."""
    varies = region.varies if region and pages >= FIXED_PAGES else 0
    return varies, 0 if varies else _size(node, inside)


def _stays(symbol, node, region, inside, whole):
    """Whether a region is main text or holds most of the ``whole``."""
    gone = _gone(symbol, inside)
    if gone != 1:
        return not gone
    varies, size = whole
    return 2 * (region.varies if region else 0) > varies if varies else 2 * _size(node, inside) > size


def _texts(node, region, inside, whole):
    """The texts of a region that stay, each with whether all pages show it there."""
    for child in node[1]:
        if isinstance(child, str):
            yield child, bool(region and region.fixed) and _hash(child) in region.fixed
            continue
        own = region and region.kids.get(child[0])
        if _stays(child[0], child, own, inside, whole):
            yield from _texts(child, own, inside or _main(child[0]), whole)


def _main_parts(node, region, whole):
    """The outermost article and main elements with their regions: outside regions that
    go, or without ``whole`` anywhere."""
    for child in node[1]:
        if isinstance(child, str):
            continue
        own = region and region.kids.get(child[0])
        if not _stays(child[0], child, own, False, whole) if whole else _main(child[0]) and _gone(child[0], False):
            continue
        if _main(child[0]):
            yield child, own
        else:
            yield from _main_parts(child, own, whole)


def _length(texts):
    return sum(len(text) for text, _ in texts)


def main_text(page, wrapper=None, pages=1):
    """The main text of a page along its host's wrapper, which ``pages`` pages made."""
    return _read(page, _Region(wrapper[3] if wrapper else (), pages), pages)


def _read(page, region, pages):
    tree = parse(page or "")
    whole = _whole(tree, region, False, pages)
    parts = list(_main_parts(tree, region, whole))
    if parts and whole[0]:
        inside, total = region.mains(whole)
        # teasers: the host's text is elsewhere
        named = 2 * inside >= total
    else:
        named = True
    texts = [] if parts and named else list(_texts(tree, region, False, whole))
    if not parts:
        # articles only in regions that go, as where a layout has a sidebar's class: they hold more than what is outside
        hidden = list(_main_parts(tree, region, None))
        if sum(_size(part, True) for part, _ in hidden) > _length(texts):
            parts = hidden
    if parts and named:
        texts = [found for part, own in parts for found in _texts(part, own, True, _whole(part, own, True, pages))]
    kept = [found for found in texts if not found[1]] if pages >= FIXED_PAGES else []
    # an article that is mostly the same on all pages is a copy, no template
    if parts and named and 2 * _length(kept) <= _length(texts):
        kept = texts
    return " ".join(text for text, _ in kept or texts)


def host_of(url):
    """A column: the host of a url in small letters, empty if there is none."""
    return F.lower(F.coalesce(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1), F.lit("")))


_PARTIAL = "host string, pages long, wrapper string"


def _fold(batches, own):
    """Merge wrappers of one host; ``own`` reads (host, pages, wrapper) rows from a batch."""
    held = {}
    for records in batches:
        for host, pages, wrapper in own(records):
            held[host] = (held[host][0] + pages, merge(held[host][1], wrapper)) if host in held else (pages, wrapper)
        if len(held) > HOSTS:
            yield _rows(held)
            held = {}
    yield _rows(held)


def _rows(held):
    return batch_of_rows(arrow_schema(_PARTIAL), [(host, pages, json.dumps(wrapper, ensure_ascii=False)) for host, (pages, wrapper) in held.items()])


def infer(pages):
    """One wrapper for each host of ``pages`` (url, html) with tags or text: host, pages, wrapper (JSON)."""

    def start(batches):
        return _fold(batches, lambda records: ((host, 1, wrapper_of(tree)) for host, page in zip(*lists(records, "host", "html")) if (tree := parse(page))[1]))

    def again(batches):
        return _fold(batches, lambda records: ((host, n, json.loads(wrapper)) for host, n, wrapper in zip(*lists(records, "host", "pages", "wrapper"))))

    rows = pages.select(host_of(F.col("url")).alias("host"), F.coalesce("html", F.lit("")).alias("html"))
    partial = rows.mapInArrow(start, _PARTIAL)
    # partial wrappers of a host meet in a few tasks first, then in one; hosts come one after another
    salted = partial.withColumn("salt", F.pmod(F.xxhash64("wrapper"), F.lit(_SALTS)))
    salted = salted.repartition("host", "salt").sortWithinPartitions("host").select("host", "pages", "wrapper").mapInArrow(again, _PARTIAL)
    return lineage.cut(salted.repartition("host").sortWithinPartitions("host").mapInArrow(again, _PARTIAL), "wrappers")


def extract(pages, wrappers):
    """page_id, url, text, n_chars for every row of ``pages`` (page_id, url, html). Small
    wrapper tables are sent to the pages by the planner, large ones are joined by host."""
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", host_of(F.col("url")).alias("host"), "html")
    out = "page_id long, url string, text string, n_chars long"

    def read(batches):
        known = functools.lru_cache(maxsize=2048)(lambda wrapper, pages: _Region(json.loads(wrapper)[3], pages))
        for records in batches:
            found = []
            for page_id, url, page, n, wrapper in zip(*lists(records, "page_id", "url", "html", "pages", "wrapper")):
                text = _read(page, known(wrapper, n) if wrapper else None, n or 1)
                found.append((page_id, url, text, len(text)))
            yield batch_of_rows(arrow_schema(out), found)

    return rows.join(wrappers, "host", "left").select("page_id", "url", "html", "pages", "wrapper").mapInArrow(read, out)


def main_texts(pages):
    """The main text of every row of ``pages`` (page_id, url, html).

    A null or empty html gives an empty text; rows with a null url share a host; null
    ids and repeated rows are kept. An empty table gives no rows. Other columns are
    not read."""
    return extract(pages, infer(pages))
