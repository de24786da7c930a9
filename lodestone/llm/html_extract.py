"""Main text of web pages: flat text blocks, classified by a decision tree on shallow features.

A page falls into blocks at the tags that begin a block. A block's features are its own word count and link density,
those of the blocks before and after it, and its innermost mark: a content element (article, main), or page furniture by element, class,
id or role. A mark further out doesn't count, so that a form around the page decides nothing within main or article (an article within
other furniture, as comments and teasers are, stays furniture), and a name that is one of a layout (layout with-sidebar) is no mark. The tree is grown from TRAINING, a table of labelled blocks.

The scanner goes over a page once. A quotation mark opens a value only after =; an end tag without its begin tag is ignored; a
hidden element that is closed by itself or never closed hides nothing (but script and style hide the rest, as in browsers);
after the last > all is text.

A null or empty page, and one without content, gives an empty text; repeated rows are extracted each; an empty table
gives no rows; other columns are ignored.
"""

from __future__ import annotations

import html
import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm.common import bounded_batches, narrow, ship

SCHEMA = "page_id long, url string, text string, n_chars long"
#: (words, link density, words before, link density before, words after, link density after, in content, in furniture, content?)
TRAINING = (
    (120, 0.00, 90, 0.0, 80, 0.0, 1, 0, 1), (60, 0.05, 0, 0.0, 75, 0.1, 1, 0, 1), (8, 0.00, 6, 1.0, 90, 0.0, 1, 0, 1), (1, 0.00, 70, 0.0, 55, 0.0, 1, 0, 1),
    (2, 0.00, 1, 0.0, 2, 0.0, 1, 0, 1), (3, 1.00, 40, 0.0, 45, 0.0, 1, 0, 1), (45, 0.40, 30, 0.1, 8, 1.0, 1, 0, 1), (5, 0.00, 12, 0.0, 4, 0.9, 1, 0, 1),
    (30, 0.00, 1, 1.0, 6, 0.0, 1, 0, 1), (14, 0.20, 80, 0.0, 9, 0.0, 1, 0, 1), (1, 0.00, 0, 0.0, 0, 0.0, 1, 0, 1), (400, 0.01, 5, 0.0, 1, 0.0, 1, 0, 1),
    (1, 1.00, 1, 1.0, 1, 1.0, 0, 1, 0), (2, 1.00, 1, 1.0, 3, 0.0, 0, 1, 0), (9, 0.00, 1, 1.0, 8, 0.0, 0, 1, 0), (6, 0.00, 60, 0.0, 0, 0.0, 0, 1, 0),
    (70, 0.00, 3, 1.0, 40, 0.0, 0, 1, 0), (25, 0.10, 2, 1.0, 2, 1.0, 0, 1, 0), (110, 0.00, 90, 0.0, 3, 0.0, 0, 1, 0), (12, 0.00, 60, 0.0, 70, 0.0, 1, 1, 0),
    (80, 0.00, 90, 0.0, 60, 0.0, 1, 1, 0), (3, 0.50, 40, 0.0, 90, 0.0, 1, 1, 0), (1, 0.00, 30, 0.0, 20, 0.0, 1, 1, 0), (35, 0.30, 8, 0.0, 9, 0.9, 1, 1, 0),
    (90, 0.00, 70, 0.0, 85, 0.0, 0, 0, 1), (55, 0.02, 10, 0.0, 60, 0.0, 0, 0, 1), (40, 0.10, 65, 0.0, 3, 1.0, 0, 0, 1), (25, 0.00, 30, 0.0, 50, 0.0, 0, 0, 1),
    (7, 0.00, 5, 0.0, 80, 0.0, 0, 0, 1), (9, 0.00, 60, 0.0, 45, 0.0, 0, 0, 1), (20, 0.00, 0, 0.0, 0, 0.0, 0, 0, 1), (16, 0.05, 40, 0.0, 0, 0.0, 0, 0, 1),
    (2, 1.00, 2, 1.0, 2, 1.0, 0, 0, 0), (4, 0.90, 1, 1.0, 60, 0.0, 0, 0, 0), (12, 0.80, 70, 0.0, 3, 1.0, 0, 0, 0), (30, 0.75, 20, 0.8, 10, 0.9, 0, 0, 0),
    (3, 0.00, 2, 1.0, 2, 0.9, 0, 0, 0), (5, 0.00, 4, 1.0, 1, 1.0, 0, 0, 0), (6, 0.60, 1, 0.9, 2, 1.0, 0, 0, 0), (50, 0.90, 5, 1.0, 9, 0.8, 0, 0, 0),
    (3, 0.00, 60, 0.0, 45, 0.0, 0, 0, 1), (2, 0.00, 80, 0.0, 70, 0.0, 0, 0, 1), (1, 0.00, 25, 0.1, 90, 0.0, 0, 0, 1), (6, 0.00, 1, 1.0, 85, 0.0, 0, 0, 1),
    (9, 0.00, 1, 1.0, 2, 1.0, 0, 0, 0), (12, 0.00, 1, 1.0, 3, 1.0, 0, 0, 0), (11, 0.10, 2, 0.9, 1, 1.0, 0, 0, 0), (8, 0.00, 3, 1.0, 4, 0.8, 0, 0, 0),
    (9, 0.00, 2, 1.0, 90, 0.0, 0, 1, 0), (14, 0.10, 1, 1.0, 120, 0.0, 0, 1, 0), (2, 1.00, 1, 1.0, 85, 0.0, 0, 1, 0), (60, 0.00, 1, 1.0, 150, 0.0, 0, 1, 0),
    (20, 0.90, 40, 0.1, 60, 0.0, 1, 0, 1), (2, 1.00, 1, 1.0, 3, 0.9, 1, 0, 1), (3, 0.00, 2, 1.0, 1, 1.0, 1, 0, 1), (30, 0.20, 4, 0.9, 2, 0.8, 1, 0, 1),
    (16, 0.00, 1, 1.0, 0, 0.0, 0, 0, 1), (18, 0.00, 2, 1.0, 4, 0.0, 0, 0, 1), (15, 0.00, 1, 1.0, 6, 0.2, 0, 0, 1),
    (4, 0.00, 0, 0.0, 75, 0.0, 0, 0, 1), (4, 0.00, 0, 0.0, 2, 1.0, 0, 0, 0), (3, 0.00, 70, 0.0, 1, 1.0, 0, 0, 1), (7, 0.00, 2, 1.0, 0, 0.0, 0, 0, 0),
)
CONTENT = {"article", "main"}
FURNITURE = {"nav", "header", "footer", "aside", "form", "menu", "dialog"}
HIDDEN = {"script", "style", "noscript", "template", "textarea", "select", "button", "svg", "iframe", "object", "head", "math", "canvas", "audio", "video", "option"}
INLINE = {"a", "abbr", "b", "bdi", "bdo", "cite", "code", "data", "dfn", "em", "font", "i", "img", "ins", "kbd", "label", "mark", "q", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr", "input", "br", "del", "big", "acronym"}
ENCLOSING = {"div", "section", "ul", "ol", "dl", "table", "blockquote", "figure", "body", "html", "center", "fieldset", "details"} | CONTENT | FURNITURE
NAMED = re.compile(r"(?:^|[\s_-])(nav|navbar|navigation|menu|header|masthead|footer|sidebar|aside|ad|ads|advert|adverts|advertisement|banner|promo|sponsor|sponsored|cookie|cookies|consent|notice|notices|alert|popup|modal|overlay|form|login|signup|subscribe|newsletter|search|comment|comments|reply|replies|discussion|respond|related|recommended|share|sharing|social|breadcrumb|breadcrumbs|pagination|pager|widget|toolbar|disclaimer|gdpr|copyright)(?:$|[\s_-])", re.I)
#: Words that make a name one of a layout, not of a part: no-sidebar, has-comments, with-sidebar.
LAYOUT = {"no", "not", "with", "without", "has", "hide", "hidden", "layout", "page", "body", "wrapper", "wrap", "container", "site", "theme", "template", "aspnetform"}
#: Elements whose content is no markup; of these, script and style hide the rest of the page if they are not closed.
RAW = {"script", "style", "textarea", "iframe", "noscript", "template", "object"}
ATTRIBUTE = re.compile(r"""(?:^|\s)(?:class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""", re.I)
NAME = re.compile("/?[a-zA-Z][a-zA-Z0-9:-]*")
TAG_END = re.compile(r"""=\s*(?:"[^"]*"|'[^']*')|>""")


def named_furniture(attributes: str) -> bool:
    """Whether a class, id or role names a part of the page's furniture."""
    for value in ATTRIBUTE.findall(attributes):
        for name in value.strip("\"'").split():
            if NAMED.search(name) and LAYOUT.isdisjoint(re.split("[_-]", name.lower())):
                return True
    return False


def tokens(page: str):
    """(text, None, None) or ("", name, attributes) of a page's texts and tags; an end tag's name begins with /."""
    at, end, last = 0, len(page), page.rfind(">")
    while at < end:
        begin = page.find("<", at)
        if begin < 0 or begin > last:
            yield page[at:], None, None
            return
        if begin > at:
            yield page[at:begin], None, None
        if page.startswith("<!--", begin):
            close = page.find("-->", begin + 4)
            at = end if close < 0 else close + 3
            continue
        if page.startswith(("<!", "<?"), begin):
            at = page.index(">", begin) + 1
            continue
        name = NAME.match(page, begin + 1)
        if not name:
            yield "<", None, None
            at = begin + 1
            continue
        stop = TAG_END.search(page, name.end())
        while stop and stop[0] != ">":
            stop = TAG_END.search(page, stop.end())
        if not stop:  # the last > is within a value
            stop = re.compile(">").search(page, name.end())
        at = stop.end()
        low = name[0].lower()
        yield "", low, page[name.end() : stop.start()]
        if low in RAW and not page[name.end() : stop.start()].rstrip().endswith("/"):
            close = re.compile(rf"</{low}(?=[\s>/])", re.I).search(page, at)
            if close:
                at = close.start()
            elif low in ("script", "style"):
                return


class Tree:
    """A binary decision tree, grown by Gini impurity."""

    def __init__(self, rows: list[tuple], depth: int = 6):
        labels = [r[-1] for r in rows]
        self.value, self.feature = sum(labels) * 2 >= len(labels), None
        if depth and 0 < sum(labels) < len(labels):
            best = None
            for f in range(len(rows[0]) - 1):
                values = sorted({r[f] for r in rows})
                for lo, hi in zip(values, values[1:]):
                    cut = (lo + hi) / 2
                    sides = [[r[-1] for r in rows if (r[f] > cut) == side] for side in (False, True)]
                    cost = sum(len(s) * 2 * (p := sum(s) / len(s)) * (1 - p) for s in sides)
                    if best is None or cost < best[0] - 1e-12:
                        best = (cost, f, cut)
            _, self.feature, self.cut = best
            self.sides = [Tree([r for r in rows if (r[self.feature] > self.cut) == side], depth - 1) for side in (False, True)]

    def __call__(self, row: tuple) -> bool:
        node = self
        while node.feature is not None:
            node = node.sides[row[node.feature] > node.cut]
        return node.value


def blocks_of(page: str) -> list[tuple[str, int, float, int, int]]:
    """(text, words, link density, in content, in furniture) of the page's blocks, in order; of the last two the innermost mark."""
    out, text, linked, links = [], [], [], 0
    stack: list[tuple[str, int, str]] = []  # open elements, the mark (1 content, 2 furniture, 3 hidden, 0 none) that holds within, and the element that made it
    count: dict[str, int] = {}
    low = page.lower()
    closes: dict[str, int] = {}

    def close() -> None:
        words = html.unescape("".join(text)).split()
        if words:
            mark = stack[-1][1] if stack else 0
            own = len(html.unescape("".join(linked)).split())
            out.append((" ".join(words), len(words), own / len(words), int(mark == 1), int(mark == 2)))
        text.clear()
        linked.clear()

    for piece, name, attributes in tokens(page):
        hidden = bool(stack) and stack[-1][1] == 3
        if name is None:
            if not hidden:
                text.append(piece)
                if links:
                    linked.append(piece)
            continue
        bare = name.lstrip("/")
        if bare in HIDDEN or bare in ENCLOSING:
            if bare not in INLINE:
                close()
                links = 0
            if name != bare:
                if count.get(bare):
                    while stack[-1][0] != bare:
                        count[stack.pop()[0]] -= 1
                    stack.pop()
                    count[bare] -= 1
                continue
            if attributes.rstrip().endswith("/"):
                continue
            around = stack[-1][1] if stack else 0
            holder = stack[-1][2] if stack else ""
            if bare in HIDDEN:
                if bare not in closes:
                    closes[bare] = low.count(f"</{bare}")
                if not closes[bare]:
                    continue
                mark = 3
            elif hidden:
                mark = 3
            elif bare in CONTENT:
                aside = around == 2 and bare != "main" and holder != "form"
                mark = 2 if aside or (bare != "main" and named_furniture(attributes)) else 1
            elif bare in FURNITURE:
                mark = around if bare == "form" and "aspnetform" in attributes.lower() else 2
            else:
                mark = 2 if bare not in ("body", "html") and named_furniture(attributes) else around
            stack.append((bare, mark, bare if mark != around or bare in FURNITURE else holder))
            count[bare] = count.get(bare, 0) + 1
        elif name == bare and bare == "a":
            links = 1
        elif bare == "a":
            links = 0
        elif bare in INLINE:
            if bare == "br" and not hidden:
                text.append(" ")
        else:
            close()
            links = 0
    close()
    return out


def main_text(page: str | None, tree: Tree) -> str:
    found = blocks_of(page or "")
    edge = ("", 0, 0.0, 0, 0)
    kept = []
    for k, (text, words, density, content, furniture) in enumerate(found):
        before, after = found[k - 1] if k else edge, found[k + 1] if k + 1 < len(found) else edge
        if tree((words, density, before[1], before[2], after[1], after[2], content, furniture)):
            kept.append(text)
    return "\n".join(kept)


def extract(pages: DataFrame) -> DataFrame:
    """SCHEMA for each page (page_id, url, html)."""
    bounded_batches(pages.sparkSession)

    def run(batches):
        tree = Tree(list(TRAINING))
        for batch in batches:
            texts = [main_text(h, tree) for h in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), batch.column(1), pa.array(texts, pa.string())], names=["page_id", "url", "text"])

    found = narrow(pages, "page_id", "url", "html").mapInArrow(run, "page_id long, url string, text string")
    return found.withColumn("n_chars", F.length("text").cast("long"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))


ship(__name__)
