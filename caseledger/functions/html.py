"""One page of HTML to title, simplified HTML and text.

The per-row helper behind the page job; Spark spreads the pages. Elements are
``[tag, attributes, children]`` lists, leaves are ``(kind, text)`` pairs.
"""

from __future__ import annotations

from html import escape
from html.parser import HTMLParser

from caseledger import rules

_VOID = frozenset(
    "area base br col embed hr img input link meta param source track wbr".split()
)
_RAW_TEXT = frozenset(("script", "style", "template"))


def _attach(children: list, part) -> None:
    """Add a child; text next to text of the same kind becomes one string."""
    last = children[-1] if children else None
    if isinstance(part, tuple) and isinstance(last, tuple) and last[0] == part[0]:
        if part[0] in ("text", "raw"):
            children[-1] = (part[0], last[1] + part[1])
            return
    children.append(part)


class _Builder(HTMLParser):
    """Nothing is closed implicitly: an end tag closes its nearest open namesake."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root: list = ["", {}, []]
        self.open = [self.root]

    def handle_starttag(self, tag, attrs):
        node = [tag, {k: v or "" for k, v in attrs}, []]
        self.open[-1][2].append(node)
        if tag not in _VOID:
            self.open.append(node)

    def handle_startendtag(self, tag, attrs):
        self.open[-1][2].append([tag, {k: v or "" for k, v in attrs}, []])

    def handle_endtag(self, tag):
        for depth in range(len(self.open) - 1, 0, -1):
            if self.open[depth][0] == tag:
                del self.open[depth:]
                return

    def handle_data(self, data):
        kind = "raw" if self.open[-1][0] in _RAW_TEXT else "text"
        _attach(self.open[-1][2], (kind, data))

    def handle_comment(self, data):
        self.open[-1][2].append(("comment", data))

    def handle_decl(self, decl):
        self.open[-1][2].append(("doctype", decl))


def parse(html: str) -> list:
    builder = _Builder()
    builder.feed(html)
    builder.close()
    return builder.root


def elements(node: list):
    """Every element below ``node`` in document order, without recursion."""
    waiting = [c for c in reversed(node[2]) if isinstance(c, list)]
    while waiting:
        found = waiting.pop()
        yield found
        waiting.extend(c for c in reversed(found[2]) if isinstance(c, list))


def strings(node: list) -> list[str]:
    """Visible text pieces, stripped, blank ones left out."""
    out, waiting = [], list(reversed(node[2]))
    while waiting:
        part = waiting.pop()
        if isinstance(part, list):
            waiting.extend(reversed(part[2]))
        elif part[0] == "text" and part[1].strip():
            out.append(part[1].strip())
    return out


def render(node: list) -> str:
    out, waiting = [], [node]
    while waiting:
        part = waiting.pop()
        if isinstance(part, str):
            out.append(part)
        elif isinstance(part, tuple):
            kind, text = part
            shape = {"comment": "<!--{}-->", "doctype": "<!{}>", "raw": "{}"}.get(kind)
            out.append(shape.format(text) if shape else escape(text, quote=False))
        else:
            tag, attributes, children = part
            if tag:
                written = "".join(f' {k}="{escape(v)}"' for k, v in attributes.items())
                if tag in _VOID:
                    out.append(f"<{tag}{written}/>")
                    continue
                out.append(f"<{tag}{written}>")
                waiting.append(f"</{tag}>")
            waiting.extend(reversed(children))
    return "".join(out)


def _as_text(part):
    """Script or style content that loses its element is ordinary text from then on."""
    return ("text", part[1]) if isinstance(part, tuple) and part[0] == "raw" else part


def rewrite(node: list, action, attach=list.append) -> list:
    """Copy of the tree in which ``action(child)`` keeps, drops or unwraps children."""
    copy = [node[0], node[1], []]
    waiting = [(part, copy[2]) for part in reversed(node[2])]
    while waiting:
        part, target = waiting.pop()
        verdict = action(part)
        if verdict == "drop":
            continue
        if not isinstance(part, list):
            attach(target, part)
        elif verdict == "unwrap":
            waiting.extend((_as_text(child), target) for child in reversed(part[2]))
        else:
            kept = [part[0], part[1], []]
            target.append(kept)
            waiting.extend((child, kept[2]) for child in reversed(part[2]))
    return copy


def _is_structure(part) -> bool:
    return isinstance(part, list) and part[0] in rules.STRUCTURE_TAGS


def _is_media(part) -> bool:
    if isinstance(part, list):
        return part[0] in rules.MEDIA_TAGS
    return part[0] == "comment"


def _is_widget(part) -> bool:
    if not isinstance(part, list):
        return False
    classes = " ".join(part[1].get("class", "").split())
    marked = f"{classes} {part[1].get('id', '')}".lower()
    return part[0] in rules.WIDGET_TAGS or any(m in marked for m in rules.WIDGET_MARKS)


STAGES = (_is_structure, _is_media, _is_widget)


def simplify(html: str) -> tuple[str, list[bool]]:
    """Reduce a page to its text markup; a stage that leaves too little is undone."""
    tree, kept = parse(html), []
    for unwanted in STAGES:
        reduced = rewrite(tree, lambda part: "drop" if unwanted(part) else "keep")
        kept.append(sum(map(len, strings(reduced))) >= rules.MIN_STAGE_CHARS)
        if kept[-1]:
            tree = rewrite(reduced, lambda part: "keep", _attach)
    body = next((e for e in elements(tree) if e[0] == "body"), None)
    if body is None:
        return render(parse(html)), kept
    flat = rewrite(
        body,
        lambda part: "unwrap"
        if isinstance(part, list) and part[0] not in rules.KEPT_TAGS
        else "keep",
    )
    return render(flat), kept


def title_of(html: str) -> str | None:
    """First acceptable title among heading, title, social title and title classes."""
    tree = parse(html)
    tests = [
        lambda e: e[0] == "h1",
        lambda e: e[0] == "title",
        lambda e: e[1].get("property") == "og:title",
    ]
    for name in rules.TITLE_CLASSES:
        tests.append(lambda e, name=name: name in e[1].get("class", "").split())
    for number, test in enumerate(tests):
        first = next(filter(test, elements(tree)), None)
        if first is None:
            continue
        text = first[1].get("content", "") if number == 2 else "".join(strings(first))
        if len(text) > rules.MIN_TITLE_CHARS:
            return text
    return None


def plain_text(html: str) -> str:
    return "\n\n".join(strings(parse(html)))


def _matches(element: list, tag: str, attribute: str | None, value: str | None) -> bool:
    if element[0] != tag or attribute is None:
        return element[0] == tag
    given = element[1].get(attribute, "")
    return value in given.split() if attribute == "class" else given == value


def _select(node: list, path):
    """Elements reached by descending through the steps of ``path``."""
    step, rest = path[0], path[1:]
    for element in elements(node):
        if _matches(element, *step):
            yield from _select(element, rest) if rest else (element,)


def _inner_text(node: list) -> str:
    return " ".join(" ".join(strings(node)).split())


def listing_rows(html: str, entry=rules.LISTING_ENTRY, fields=rules.LISTING_FIELDS) -> list[dict]:
    """Result blocks of a listing page; whatever is absent reads ``N/A``."""
    rows = []
    for block in _select(parse(html), (entry,)):
        found = {name: next(_select(block, path), None) for name, path in fields.items()}
        row = {
            name: _inner_text(node) if node else rules.MISSING_TEXT
            for name, node in found.items()
        }
        row["title"] = row["link"]
        row["link"] = found["link"][1].get("href") if found["link"] else rules.MISSING_TEXT
        rows.append(row)
    return rows
