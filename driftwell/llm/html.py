"""Layout-aware HTML extraction: all visible text, laid out as a reader would see it.

A tree builder reads tags with implied ends (a block ends an open paragraph, an item the item before it, a
cell the cell before it, and so on); visibility rules drop scripts, styles, heads, templates, comments, fallback
content (of object, noscript, iframe, audio, video, canvas), descriptions in svg and math, dialogs that aren't open, all of a closed details but its
summary, elements marked hidden and those styled away, by a style attribute or by the rules of style elements.  Of several declarations the one
that counts in a browser does: by !important, attribute before rules, ids, classes and tags of the selector, and the later one.  Selectors are
tags, classes and ids, within one another (a b) or right within (a > b); others don't apply.  Visibility is handed down and can be given back to a child.
All options of a select are shown.  The layout keeps block spacing, line breaks, list marks with nesting and numbers, preformatted text (tabs
to every eighth place) and tables: cells keep their lines, spans their columns, and columns line up.  Only where that takes more than BLANKS
blanks for each character of a table, cells wider than WIDEST move what follows them instead.

Tags are found in time that grows with the page.  Elements more than DEEPEST deep are laid side by side, as in browsers.

Rows: null and empty pages give an empty text.  Broken mark-up never fails; text outside any tag is kept.
Repeated rows are rendered alike; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

NAME = re.compile(r"/?[a-zA-Z][^\s/>]*")
PLAIN = re.compile(r"[^>\"']*")
COMMENT_END = re.compile(r"--!?>")
ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
DECLARED = re.compile(r"(?:^|[;\s])(display|visibility)\s*:\s*([a-z-]+)\s*(!\s*important)?", re.I)
COMPOUND = re.compile(r"(>?)\s*([^\s>]+)\s*")
SELECTOR = re.compile(r"([a-zA-Z][\w-]*|\*)?((?:[.#][\w-]+)*)")
WIDEST, BLANKS, DEEPEST = 60, 16, 512  # columns of tables that can't be lined up; elements in one another, as browsers keep it
SPACE = re.compile(r"[ \t\n\r\f]+")
# Element names of the HTML standard.
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
RAW = {"script", "style", "textarea", "title", "xmp", "iframe", "noembed", "noframes"}
UNSEEN = {"script", "style", "head", "title", "template", "noscript", "iframe", "noembed", "noframes", "object", "audio", "video", "canvas", "datalist", "defs", "desc", "metadata", "annotation", "annotation-xml"}
SPACED = {"p", "h1", "h2", "h3", "h4", "h5", "h6", "ul", "ol", "dl", "blockquote", "pre", "table", "figure", "hr"}
BLOCK = SPACED | {"address", "article", "aside", "body", "center", "dd", "details", "dialog", "div", "dt", "fieldset", "figcaption", "footer", "form", "header", "hgroup", "html", "legend", "li", "main", "menu", "nav", "section", "summary", "tr", "caption", "thead", "tbody", "tfoot", "optgroup", "option", "text"}
INNER = {"optgroup", "option", "text"}  # lines of their own within a paragraph (text: of svg)
CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "option": ({"option"}, {"select"}),
    "optgroup": ({"option", "optgroup"}, {"select"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "caption", "colgroup"}, {"table"}),
    "td": ({"td", "th"}, {"table", "tr"}),
    "th": ({"td", "th"}, {"table", "tr"}),
    "thead": ({"thead", "tbody", "tfoot", "caption", "colgroup"}, {"table"}),
    "tbody": ({"thead", "tbody", "tfoot", "caption", "colgroup"}, {"table"}),
    "tfoot": ({"thead", "tbody", "tfoot", "caption", "colgroup"}, {"table"}),
}
FENCES = {"table", "td", "th", "caption", "object", "template", "html"}


class Node:
    """An element: gone (never rendered), hidden (unless a style shows it), style, names for rules, lists' and cells' numbers, whether it's open."""

    __slots__ = ("across", "back", "children", "down", "gone", "hidden", "names", "open", "start", "style", "tag")

    def __init__(self, tag: str, gone: bool = False):
        self.tag, self.gone, self.hidden, self.style, self.names, self.children = tag, gone, tag == "dialog", {}, (), []
        self.start, self.across, self.down, self.back, self.open = None, 1, 1, False, False


def styled(style: str) -> dict[str, tuple[bool, bool]]:
    """display and visibility of declarations: (important, shown); the last counts, and important ones before others."""
    out: dict[str, tuple[bool, bool]] = {}
    for name, value, important in DECLARED.findall(style):
        name, value, important = name.lower(), value.lower(), bool(important)
        if name == "visibility" and value not in ("visible", "hidden", "collapse"):
            continue
        if name not in out or important >= out[name][0]:
            out[name] = important, value == "visible" if name == "visibility" else value != "none"
    return out


def element(tag: str, attributes: str) -> Node:
    node = Node(tag, tag in UNSEEN)
    if not attributes or node.gone:
        return node
    for name, a, b, c in ATTRIBUTE.findall(attributes):
        name, value = name.lower(), a or b or c
        if name == "hidden":
            node.hidden = True
        elif name == "open":
            node.open = True
            node.hidden &= tag != "dialog"
        elif name == "reversed":
            node.back = tag == "ol"
        elif name == "style":
            node.style = styled(unescape(value))
        elif name == "class":
            node.names += tuple("." + x for x in unescape(value).split())
        elif name == "id":
            node.names += ("#" + unescape(value),)
        elif name in ("start", "value", "colspan", "rowspan") and re.fullmatch(r"-?\d{1,9}", value):
            if name == {"ol": "start", "li": "value"}.get(tag):
                node.start = int(value)
            elif name == "colspan":
                node.across = min(max(int(value), 1), 1000)
            elif name == "rowspan":
                node.down = min(max(int(value), 1), 65534)
    return node


def selector(text: str) -> list[tuple[str, set[str]]] | None:
    """The compounds of a selector from the last to the first, each with what stands before it (> or nothing) and its names."""
    out = []
    for inside, one in COMPOUND.findall(text):
        k = SELECTOR.fullmatch(one)
        if not k:
            return None
        out.append((inside, {*([k[1].lower()] if k[1] and k[1] != "*" else []), *re.findall(r"[.#][^.#]+", k[2])}))
    return out[::-1] or None


def rules_of(sheet: str) -> dict[str, list]:
    """The rules of a style sheet that hide or show: by a name of their last compound, lists of (rank, compounds, style).

    Rules inside @media and the like don't apply.
    """
    out: dict[str, list] = {}
    depth, at, head, order = 0, 0, "", 0
    sheet = " ".join(part.split("*/", 1)[-1] if i else part for i, part in enumerate(sheet.split("/*")))
    for m in re.finditer(r"[{}]", sheet):
        part, at = sheet[at : m.start()], m.end()
        if m[0] == "{":
            depth += 1
            if depth == 1:
                head = part.rsplit(";", 1)[-1]
        else:
            if depth == 1 and not head.lstrip().startswith("@") and len(head) < 10_000 and (style := styled(part)):
                order += 1
                for one in head.split(","):
                    if compounds := selector(one.strip()):
                        kinds = [n[0] for _, names in compounds for n in names]
                        rank = (kinds.count("#"), kinds.count("."), len(kinds), order)
                        out.setdefault(max(compounds[0][1], key=lambda n: (n[0] in ".#", n), default="*"), []).append((rank, compounds, style))
            depth = max(0, depth - 1)
    return out


def applies(compounds: list[tuple[str, set[str]]], node: Node, above: list) -> bool:
    """Whether a selector matches an element below these open ones, each the first of its entry."""
    if not compounds[0][1] <= {node.tag, *node.names}:
        return False
    places = {len(above)}  # where the last compound looked at can stand
    for (inside, _), (_, names) in zip(compounds, compounds[1:]):
        fits = lambda i: names <= {above[i][0].tag, *above[i][0].names}  # noqa: B023, E731
        places = {p - 1 for p in places if p and fits(p - 1)} if inside else {i for i in range(max(places)) if fits(i)}
        if not places:
            return False
    return True


def looks(node: Node, rules: dict[str, list], inherited: bool, above: list) -> tuple[bool, bool]:
    """(rendered, text visible) of an element below the open ones."""
    if node.gone:
        return False, False
    # by importance, attribute before rules, the selector's rank: the largest counts
    found = {"display": (False, -1, (), not node.hidden), "visibility": (False, -1, (), inherited)}
    if rules:
        for name in ("*", node.tag, *node.names):
            for rank, compounds, style in rules.get(name, ()):
                if applies(compounds, node, above):
                    for what, (important, shown) in style.items():
                        found[what] = max(found[what], (important, 0, rank, shown))
    for what, (important, shown) in node.style.items():
        found[what] = max(found[what], (important, 1, (), shown))
    return found["display"][-1], found["display"][-1] and found["visibility"][-1]


def label_of(attributes: str) -> str:
    """The label attribute, which a browser shows of an option in place of its text and of a group before its options."""
    return next((unescape(a or b or c) for name, a, b, c in ATTRIBUTE.findall(attributes) if name.lower() == "label"), "").strip()


class Scanner:
    """Finds mark-up in time that grows with the page: what can't be closed any more is told by the last place of each sign."""

    def __init__(self, html: str):
        self.html = html
        self.last = {c: html.rfind(c) for c in ">\"'"}
        self.plain = 0  # as far as here no tag was found to end

    def mark(self, lt: int) -> tuple[int, str, str] | None:
        """(end, name, attributes) of the tag, comment or declaration at a '<', the name empty unless it's a tag; None for plain text."""
        html = self.html
        nxt = html[lt + 1 : lt + 2]
        if html.startswith("<!--", lt):
            m = COMMENT_END.search(html, lt + 2)
            return (m.end() if m else len(html)), "", ""
        name = NAME.match(html, lt + 1)
        if not name:
            if nxt and nxt in "!?/" and self.last[">"] > lt:
                return html.index(">", lt) + 1, "", ""
            return None
        at = name.end()
        while True:
            at = PLAIN.match(html, at).end()
            if self.last[">"] < at:
                self.plain = at
                return None
            if html[at] == ">":
                return at + 1, name[0], html[name.end() : at]
            quote = html[at]
            # a quote that is never closed is a sign like any other
            at = html.index(quote, at + 1) + 1 if self.last[quote] > at else at + 1


def build(html: str) -> Node:
    """The page's tree; children are nodes and strings."""
    root = Node("html")
    scanner = Scanner(html)
    stack, open_tags = [root], {"html": 1}

    def pop_to(depth: int) -> None:
        while len(stack) > depth:
            open_tags[stack.pop().tag] -= 1

    def find(names: set[str], fences: set[str]) -> int:
        """The depth of the innermost open element of these names that no fence hides; 0 if none."""
        if not any(open_tags.get(n) for n in names):
            return 0
        for d in range(len(stack) - 1, 0, -1):
            if stack[d].tag in names:
                return d
            if stack[d].tag in fences:
                return 0
        return 0

    at, n = 0, len(html)
    while at < n:
        lt = html.find("<", at)
        m = scanner.mark(lt) if lt >= 0 else None
        if lt < 0 or (not m and scanner.last[">"] < lt):
            stack[-1].children.append(unescape(html[at:]))
            break
        if lt > at or not m:
            end = lt if m else max(lt + 1, scanner.plain)
            stack[-1].children.append(unescape(html[at:end]))
            if not m:
                at = end
                continue
        at, name, attributes = m
        if not name:
            continue
        tag = name.lstrip("/").lower()
        if name[0] == "/":
            if tag == "p" and not find({"p"}, FENCES):
                stack[-1].children.append(Node("p"))
            elif d := find({tag}, FENCES - {tag} if tag in ("td", "th", "caption") else {"table"} - {tag} if tag not in ("tr", "thead", "tbody", "tfoot") else set()):
                pop_to(d)
            elif tag == "br":
                stack[-1].children.append(Node("br"))
            continue
        if tag in ("html", "body") and tag == "html":
            continue
        if tag in BLOCK and open_tags.get("head") and tag != "head":
            if d := find({"head"}, set()):
                pop_to(d)
        if tag == "body" and (d := find({"head"}, set())):
            pop_to(d)
        if tag in CLOSES:
            names, fences = CLOSES[tag]
            if d := find(names, fences):
                pop_to(d)
        if tag in ("tr", "thead", "tbody", "tfoot") and (d := find({"td", "th"}, {"table"})):
            pop_to(d)
            if d := find(CLOSES[tag][0], {"table"}):
                pop_to(d)
        if tag in BLOCK - INNER and (d := find({"p"}, FENCES)):
            pop_to(d)
        node = element(tag, attributes)
        if tag in ("option", "optgroup") and (label := label_of(attributes)):
            shown = element(tag, attributes)
            shown.children.append(label)
            (stack[-1] if tag == "option" else node).children.append(shown)
            node.gone |= tag == "option"
        stack[-1].children.append(node)
        if tag in VOID or (attributes.endswith("/") and (open_tags.get("svg") or open_tags.get("math"))):
            continue
        if tag in RAW:
            end = re.compile(f"</{re.escape(tag)}(?=[\\s/>])[^>]*>?", re.I).search(html, at)
            node.children.append(unescape(html[at : end.start() if end else n]) if tag in ("textarea", "title") else html[at : end.start() if end else n])
            at = end.end() if end else n
            continue
        if len(stack) < DEEPEST:
            stack.append(node)
            open_tags[tag] = open_tags.get(tag, 0) + 1
    return root


def sheets(root: Node) -> str:
    """The text of all style elements."""
    out, todo = [], [root]
    while todo:
        node = todo.pop()
        if node.tag == "style":
            out.append("".join(c for c in node.children if isinstance(c, str)))
        todo.extend(c for c in reversed(node.children) if isinstance(c, Node))
    return "\n".join(out)


class Flow:
    """Lines of a block being laid out."""

    def __init__(self):
        self.lines: list[str] = []
        self.parts: list[str] = []
        self.blank = False  # a blank line is due before the next text
        self.prefix, self.mark = "", ""

    def text(self, s: str) -> None:
        self.parts.append(s)

    def close(self, spaced: bool = False) -> None:
        line = SPACE.sub(" ", "".join(self.parts)).strip(" ")
        self.parts.clear()
        if line:
            self.put([line])
        self.blank |= spaced

    def put(self, lines: list[str]) -> None:
        if self.blank and self.lines:
            self.lines.append("")
        self.blank = False
        for line in lines:
            self.lines.append((self.prefix + self.mark + line).rstrip())
            self.prefix += " " * len(self.mark)
            self.mark = ""

    def result(self) -> list[str]:
        self.close()
        return self.lines


class Table:
    """Cells by row and column, spans kept free."""

    def __init__(self, flow: Flow):
        self.flow, self.rows, self.taken = flow, [], {}

    def row(self) -> None:
        self.rows.append([])

    def cell(self, across: int, down: int):
        """A place for a cell's lines in the current row: (column, columns, lines)."""
        if not self.rows:
            self.row()
        row = self.rows[-1]
        at = row[-1][0] + row[-1][1] if row else 0
        while self.taken.get(at, 0) >= len(self.rows):  # the last row that a cell above reaches into
            at += 1
        if down > 1:
            self.taken |= dict.fromkeys(range(at, at + across), len(self.rows) + down - 1)
        row.append((at, across, []))
        return row[-1][2]

    def places(self, widest: float) -> dict[int, int]:
        """Where each column begins; wider cells count as `widest`."""
        wide: dict[int, int] = {}
        for row in self.rows:
            for at, across, lines in row:
                held = max(map(len, lines), default=0)
                wide[at] = max(wide.get(at, 0), min(held, widest) if across == 1 else 0)
        left, x = {}, 0
        for c in sorted(wide):
            left[c] = x
            x += wide[c] + 2 if wide[c] else 0
        return left

    def lines(self) -> list[str]:
        """The cells lined up in columns, two blanks between them."""
        left = self.places(float("inf"))
        held = [(at, len(x)) for row in self.rows for at, _, lines in row for x in lines]
        if sum(left[at] for at, _ in held) > (BLANKS + 1) * sum(n for _, n in held) + 4096:
            left = self.places(WIDEST)
        out = []
        for row in self.rows:
            for k in range(max((len(lines) for _, _, lines in row), default=0)):
                line = ""
                for at, _, lines in row:
                    if k < len(lines) and lines[k]:
                        line = line.ljust(left[at]) if len(line) + 2 <= left[at] or not line else line + "  "
                        line += lines[k]
                out.append(line)
        return out


def render(root: Node) -> str:
    """The visible text of a tree, without recursion."""
    flow = Flow()
    out = flow
    # what is open: (node, next child, what to do at its end)
    lists: list[list] = []
    tables: list[Table] = []
    pre = 0
    rules = rules_of(sheets(root))
    stack: list[list] = [[root, 0, None, True]]
    while stack:
        top = stack[-1]
        node, k, end, shown = top
        if k == len(node.children):
            stack.pop()
            if end:
                end()
            continue
        top[1] = k + 1
        child = node.children[k]
        if node.tag == "details" and not node.open:
            if isinstance(child, str) or child.tag != "summary":
                continue
            top[1] = len(node.children)  # the first summary alone
        if isinstance(child, str):
            if not shown:
                continue
            if pre:
                head, *more = child.expandtabs(8).split("\n")
                flow.text(head.replace(" ", " "))
                for line in more:
                    whole = "".join(flow.parts)
                    flow.parts.clear()
                    flow.put([whole])
                    flow.text(line.replace(" ", " "))
            else:
                flow.text(child)
            continue
        tag = child.tag
        rendered, shown = looks(child, rules, shown, stack)
        if not rendered:
            continue
        if tag == "br":
            if not flow.parts and flow.lines and not flow.blank:
                flow.lines.append("")
            flow.close()
            continue
        if tag not in BLOCK and tag not in ("td", "th"):
            stack.append([child, 0, None, shown])
            continue
        if tag in ("td", "th"):
            if tables:
                outer, lines, cell, outside = flow, tables[-1].cell(child.across, child.down), Flow(), lists
                flow, lists = cell, []

                def cell_end(outer=outer, lines=lines, cell=cell, outside=outside):
                    nonlocal flow, lists
                    lines.extend(x for x in cell.result() if x.strip())
                    flow, lists = outer, outside

                stack.append([child, 0, cell_end, shown])
            else:
                flow.text(" ")
                stack.append([child, 0, None, shown])
            continue
        if tag == "tr":
            if tables:
                tables[-1].row()
            stack.append([child, 0, None, shown])
            continue
        flow.close(tag in SPACED and not (tag in ("ul", "ol") and lists))
        if tag == "table":
            tables.append(Table(flow))

            def table_end():
                nonlocal flow
                table = tables.pop()
                flow = table.flow
                flow.close()
                if lines := [x for x in table.lines() if x]:
                    flow.put(lines)
                flow.blank = True

            stack.append([child, 0, table_end, shown])
        elif tag in ("ul", "ol", "menu"):
            items = sum(isinstance(c, Node) and c.tag == "li" for c in child.children) if child.back and child.start is None else 1
            lists.append([tag, items if child.start is None else child.start, -1 if child.back else 1])

            def list_end(flow=flow):
                flow.close()
                lists.pop()
                flow.blank |= not lists

            stack.append([child, 0, list_end, shown])
        elif tag == "li":
            kept = flow.prefix
            mark = "- "
            if lists and lists[-1][0] == "ol":
                number = lists[-1][1] if child.start is None else child.start
                mark = f"{number}. "
                lists[-1][1] = number + lists[-1][2]
            flow.prefix, flow.mark = kept, mark

            def item_end(flow=flow, kept=kept):
                flow.close()
                flow.prefix, flow.mark = kept, ""

            stack.append([child, 0, item_end, shown])
        elif tag == "pre":
            pre += 1

            def pre_end(flow=flow):
                nonlocal pre
                pre -= 1
                flow.close(True)

            stack.append([child, 0, pre_end, shown])
        else:
            spaced = tag in SPACED
            kept = flow.prefix
            if tag in ("blockquote", "dd"):
                flow.prefix += "  "

            def block_end(flow=flow, spaced=spaced, kept=kept):
                flow.close(spaced)
                flow.prefix = kept if not flow.mark else flow.prefix

            stack.append([child, 0, block_end, shown])
    return "\n".join(out.result()).replace(" ", " ").strip("\n")


def extract_text(html: str | None) -> str:
    return render(build(html or ""))


def extract_pages(pages: DataFrame) -> DataFrame:
    """page_id, text, n_chars, n_lines of every whole page."""

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                texts = [extract_text(h) for h in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0),
                        pa.array(texts, pa.string()),
                        pa.array([len(t) for t in texts], pa.int64()),
                        pa.array([t.count("\n") + 1 if t else 0 for t in texts], pa.int64()),
                    ],
                    ["page_id", "text", "n_chars", "n_lines"],
                )

    return pages.select(F.col("page_id").cast("long"), F.col("html").cast("string")).mapInArrow(
        run, "page_id long, text string, n_chars long, n_lines long"
    )
