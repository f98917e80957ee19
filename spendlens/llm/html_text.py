"""Main text of web pages: a linear-chain conditional random field over leaf blocks.

A page is cut into leaf blocks: runs of text under one block element. A block
is described by its own tag, its ancestors (nearest landmark, any landmark, kinds
named by class, id and role), and its text (length, links, punctuation). The
field has one weight for each description and label and one for each pair of
neighbouring labels. It is trained on labelled pages by stochastic gradient on
the exact log-likelihood (forward-backward) and decoded by Viterbi.

Labelled pages come as (html, [is main text, one for each leaf block]).
``examples`` writes such pages in many layouts, closed and unclosed, with the
parts that are no article: menus, headers, footers, sidebars, notices, adverts,
forms, reader comments. The learned weights are a few kilobytes, whatever the
pages, and are broadcast; pages are scored in place, without a shuffle.

Defined results: null or empty html and pages without main text give an empty
text; a tag cut off by the end of the page is dropped; unclosed elements end with
their parent; repeated rows give repeated results; columns of the pages pass
through, and one named like a result is replaced by it.
"""

from __future__ import annotations

import random
import re
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from spendlens.llm.common import small_batches

# fixed values: element names of HTML, by the role they play here
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
SILENT = set("script style template noscript title textarea select svg math iframe object audio video canvas datalist".split())
INLINE = set(
    "a abbr acronym b bdi bdo big button cite code data del dfn em font i ins kbd label mark nobr output q rp rt ruby s samp "
    "small span strike strong sub sup time tt u var wbr br img input meta link".split()
)
LANDMARKS = set("nav header footer aside form article main section dialog menu figure table blockquote details".split())
ENDS_P = set(
    "address article aside blockquote details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p "
    "pre section table ul".split()
)
SIBLINGS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SCOPES = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"tr", "table"}, "th": {"tr", "table"}}

# words in class, id and role attributes, by the kind of block they name
KINDS = {
    "menu": "nav navbar navigation menu menubar breadcrumb breadcrumbs crumbs toc pagination pager tabs tablist skip",
    "header": "header masthead topbar banner logo branding hero toolbar",
    "footer": "footer foot bottom copyright colophon legal contentinfo imprint",
    "side": "sidebar side aside rail widget widgets related recommended recommendations trending popular complementary more tags tagcloud",
    "notice": "notice notices cookie cookies consent gdpr alert alertdialog modal popup overlay message messages warning disclaimer paywall infobox toast dialog hint announcement",
    "ad": "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner-ad adbox adslot affiliate",
    "form": "form login signup signin register search subscribe subscription newsletter contact feedback survey poll input",
    "comments": "comment comments commentlist discussion disqus reply replies respond response responses reader readers reviews guestbook",
    "share": "share sharing social follow buttons like byline author-box",
    "content": "content article post entry story body text main page maintext prose copy single",
}
KIND_OF = {word: kind for kind, words in KINDS.items() for word in words.split()}


class _Leaves(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.stack: list[tuple[str, tuple[str, ...]]] = []
        self.text: list[str] = []
        self.linked = self.silent = 0
        self.blocks: list[tuple[str, list[str]]] = []

    def flush(self):
        text = " ".join("".join(self.text).split())
        if text:
            self.blocks.append((text, self.describe(text)))
        self.text, self.linked = [], 0

    def describe(self, text):
        open_ = [(t, k) for t, k in self.stack if t not in INLINE or k]
        tags = [t for t, _ in open_ if t not in INLINE]
        out = [f"tag={tags[-1] if tags else 'none'}"]
        marks = [t for t in tags if t in LANDMARKS]
        kinds = [k for _, ks in open_ for k in ks]
        out.append(f"near={marks[-1] if marks else 'none'}")
        out += [f"in={t}" for t in sorted(set(marks))]
        out.append(f"kind={kinds[-1] if kinds else 'none'}")
        out += [f"of={k}" for k in sorted(set(kinds))]
        order = [t if t in LANDMARKS else k for t, ks in open_ for k in ([t] if t in LANDMARKS else []) + list(ks)]
        out.append(f"last={order[-1] if order else 'none'}")
        n = len(text.split())
        out.append(f"words={sum(n >= x for x in (2, 4, 8, 16, 32))}")
        share = self.linked / max(1, len(text))
        out.append("links=all" if share > 0.9 else "links=some" if share > 0.3 else "links=few")
        out.append(f"end={text[-1] in '.!?…:;"”'}")
        if "©" in text:
            out.append("copyright")
        return out

    def pop_to(self, i):
        if any(t not in INLINE for t, _ in self.stack[i:]):
            self.flush()
        del self.stack[i:]

    def handle_starttag(self, tag, attrs):
        if self.silent:
            self.silent += tag in SILENT
            return
        if tag in SILENT:
            self.silent = 1
            return
        if tag == "br" or tag == "hr" or tag == "img":
            self.text.append(" ")
        if tag in VOID:
            if tag == "hr":
                self.flush()
            return
        if tag not in INLINE:
            self.flush()
            names = [t for t, _ in self.stack]
            if tag in ENDS_P and "p" in names:
                at = len(names) - 1 - names[::-1].index("p")
                if not any(t in LANDMARKS or t in ("div", "td", "li") for t in names[at + 1 :]):
                    del self.stack[at:]
            if tag in SIBLINGS:
                for i in range(len(self.stack) - 1, -1, -1):
                    if self.stack[i][0] in SCOPES.get(tag, ()):
                        break
                    if self.stack[i][0] in SIBLINGS[tag]:
                        del self.stack[i:]
                        break
        words = []
        for name, value in attrs:
            if name in ("class", "id", "role") and value:
                words += re.sub(r"([a-z])([A-Z])", r"\1 \2", value).lower().replace("_", " ").replace("-", " ").split()
            elif name == "hidden" or (name == "aria-hidden" and value == "true") or (name == "style" and "display:none" in (value or "").replace(" ", "")):
                words.append("popup")
        self.stack.append((tag, tuple(KIND_OF[w] for w in words if w in KIND_OF)))

    def handle_startendtag(self, tag, attrs):
        if tag in VOID:
            self.handle_starttag(tag, attrs)
        elif not self.silent and tag not in INLINE:
            self.flush()

    def handle_endtag(self, tag):
        if self.silent:
            self.silent -= tag in SILENT
            return
        if tag == "p" and not any(t == "p" for t, _ in self.stack):
            self.flush()
        for i in range(len(self.stack) - 1, -1, -1):
            if self.stack[i][0] == tag:
                if tag in INLINE and any(t not in INLINE for t, _ in self.stack[i:]):
                    return  # an inline end does not close the blocks opened inside it
                self.pop_to(i)
                return

    def handle_data(self, data):
        if not self.silent:
            self.text.append(data)
            if any(t == "a" for t, _ in self.stack):
                self.linked += len(data.strip())


def leaves(html: str | None) -> list[tuple[str, list[str]]]:
    """Text and descriptions of each leaf block, in page order."""
    cut = (html or "").rfind("<")
    if cut >= 0 and ">" not in html[cut:] and re.match(r"<[A-Za-z/!?]", html[cut:] + " "):
        html = html[:cut]
    parser = _Leaves()
    parser.feed(html or "")
    parser.close()
    parser.flush()
    blocks = parser.blocks
    for i, (_, seen) in enumerate(blocks):
        if i == 0:
            seen.append("first")
        if i == len(blocks) - 1:
            seen.append("final")
    return blocks


class Field:
    """Weights by description and label, and by neighbouring labels."""

    def __init__(self):
        self.own: dict[str, np.ndarray] = {}
        self.pair = np.zeros((2, 2))

    def emissions(self, page: list[list[str]]) -> np.ndarray:
        none = np.zeros(2)
        return np.array([sum((self.own.get(f, none) for f in block), none) for block in page])

    def decode(self, page: list[list[str]]) -> list[int]:
        if not page:
            return []
        e = self.emissions(page)
        best, back = e[0], []
        for row in e[1:]:
            via = best[:, None] + self.pair
            back.append(via.argmax(axis=0))
            best = via.max(axis=0) + row
        out = [int(best.argmax())]
        for choice in reversed(back):
            out.append(int(choice[out[-1]]))
        return out[::-1]

    def likelihood(self, page, labels):
        """Log-likelihood of the labels, its gradient by emission, and by pair."""
        e = self.emissions(page)
        n = len(e)
        fore, back = np.zeros((n, 2)), np.zeros((n, 2))
        fore[0] = e[0]
        for i in range(1, n):
            fore[i] = e[i] + np.logaddexp.reduce(fore[i - 1][:, None] + self.pair, axis=0)
        for i in range(n - 2, -1, -1):
            back[i] = np.logaddexp.reduce(self.pair + (e[i + 1] + back[i + 1])[None, :], axis=1)
        total = np.logaddexp.reduce(fore[-1])
        own = -np.exp(fore + back - total)
        own[np.arange(n), labels] += 1
        pair = np.zeros((2, 2))
        for i in range(n - 1):
            pair -= np.exp(fore[i][:, None] + self.pair + (e[i + 1] + back[i + 1])[None, :] - total)
            pair[labels[i], labels[i + 1]] += 1
        score = e[np.arange(n), labels].sum() + sum(self.pair[a, b] for a, b in zip(labels, labels[1:]))
        return score - total, own, pair


def train(pages: list[tuple[str, list[int]]], epochs: int = 8, rate: float = 0.3, decay: float = 1e-3, seed: int = 0) -> Field:
    """A field fitted to labelled pages by AdaGrad on the log-likelihood."""
    field, rng = Field(), random.Random(seed)
    ready = [([seen for _, seen in leaves(html)], labels) for html, labels in pages]
    ready = [(page, labels) for page, labels in ready if page and len(page) == len(labels)]
    grown: dict[str, np.ndarray] = {}
    pair_grown = np.full((2, 2), 1e-6)
    for _ in range(epochs):
        rng.shuffle(ready)
        for page, labels in ready:
            _, own, pair = field.likelihood(page, labels)
            change: dict[str, np.ndarray] = {}
            for block, g in zip(page, own):
                for f in block:
                    change[f] = change.get(f, 0) + g
            for f, g in change.items():
                w = field.own.setdefault(f, np.zeros(2))
                g = g - decay * w
                grown[f] = grown.get(f, 1e-6) + g * g
                w += rate * g / np.sqrt(grown[f])
            pair = pair - decay * field.pair
            pair_grown += pair * pair
            field.pair += rate * pair / np.sqrt(pair_grown)
    return field


def examples(n: int = 500, seed: int = 11) -> list[tuple[str, list[int]]]:
    """Labelled pages in varied layouts; words are nonsense, structure is what is learned."""
    rng = random.Random(seed)
    syllables = "ta re mi lo chu en vi sol par ung ist der que an".split()
    word = lambda: "".join(rng.choice(syllables) for _ in range(rng.randint(1, 4)))

    def say(low, high):
        words = [word() for _ in range(rng.randint(low, high))]
        return " ".join(words).capitalize() + rng.choice([".", ".", ".", "", ","])

    pick, chance = rng.choice, lambda p: rng.random() < p
    out = []
    for _ in range(n):
        html, labels = [], []
        loose = chance(0.3)  # a writer who leaves elements open

        def block(tag, text, label, attr="", close=True):
            if not text.strip():
                return
            inner = text
            if chance(0.3):
                words = inner.split(" ")
                i = rng.randrange(len(words))
                words[i] = pick(["<b>%s</b>", "<em>%s</em>", "<a href='#'>%s</a>", "<span>%s</span>"]) % words[i]
                inner = " ".join(words)
            html.append(f"<{tag}{attr}>{inner}" + (f"</{tag}>" if close and not (loose and tag in ("p", "li") and chance(0.5)) else ""))
            labels.append(label)

        def named(words):
            return pick([' class="%s"', ' id="%s"', ' class="box %s"']) % pick(words)

        def links(label=0):
            tag = pick(["ul", "ol", "div"])
            html.append(f"<{tag}>")
            for _ in range(rng.randint(2, 6)):
                text = f'<a href="/x">{say(1, 3)}</a>'
                html.append(f"<li>{text}</li>" if tag != "div" else f"<p>{text}</p>")
                labels.append(label)
            html.append(f"</{tag}>")

        def part(kind):
            words = KINDS[kind].split()
            tags = {"menu": ["nav", "nav", "div"], "header": ["header", "div"], "footer": ["footer", "footer", "div"], "side": ["aside", "aside", "div"],
                    "notice": ["div", "div", "section", "aside", "p"], "ad": ["div", "div", "aside", "section", "p"], "form": ["form", "form", "div"],
                    "comments": ["section", "div", "ol", "aside"], "share": ["div", "ul"]}[kind]
            tag = pick(tags)
            attr = "" if tag in ("nav", "header", "footer", "aside", "form") and chance(0.5) else named(words)
            if tag in ("p", "ol", "ul") or (kind in ("ad", "notice", "footer", "share") and chance(0.6)):
                if tag in ("ol", "ul"):
                    html.append(f"<{tag}{attr}>")
                    for _ in range(rng.randint(1, 4)):
                        block("li", say(1, 25), 0)
                    html.append(f"</{tag}>")
                else:
                    block(tag, ("&copy; " if kind == "footer" and chance(0.5) else "") + say(1, 30), 0, attr)
                return
            html.append(f"<{tag}{attr}>")
            if kind in ("menu", "side", "share") and chance(0.7):
                links()
            if kind == "form":
                block("label", say(1, 5), 0)
                html.append('<input name="q"><button>Ok</button>')
                labels[-1] = 0
                if chance(0.5):
                    block("p", say(1, 12), 0)
            elif kind == "header":
                block(pick(["h1", "div", "p"]), say(1, 6), 0)
            else:
                if chance(0.4):
                    block(pick(["h2", "h3", "h4"]), say(1, 4), 0)
                for _ in range(rng.randint(1, 4)):
                    inner = pick(["p", "div", "p", "article"]) if kind == "comments" else pick(["p", "div"])
                    block(inner, say(1, 45 if kind == "comments" else 25), 0, named(words) if chance(0.4) else "")
            html.append(f"</{tag}>")

        def content():
            low = pick([1, 1, 5, 20])
            kind = rng.random()
            if kind < 0.72:
                block("p", say(low, low + rng.randint(0, 60)), 1)
            elif kind < 0.8:
                block(pick(["h2", "h3"]), say(1, 8), 1)
            elif kind < 0.86:
                html.append("<ul>")
                for _ in range(rng.randint(1, 4)):
                    block("li", say(1, 15), 1)
                html.append("</ul>")
            elif kind < 0.92:
                html.append("<blockquote>")
                block("p", say(3, 30), 1)
                html.append("</blockquote>")
            elif kind < 0.96:
                html.append("<table><tr>")
                for _ in range(3):
                    block("td", say(1, 4), 1)
                html.append("</tr></table>")
            else:
                block(pick(["pre", "div"]), say(3, 30), 1)

        for kind in ("notice", "header", "menu", "ad", "side"):
            if chance(0.5):
                part(kind)
        holder = pick([("article", ""), ("article", ""), ("article", named(["post", "entry", "story"])), ("main", ""), ("div", named(KINDS["content"].split())), ("section", named(["content", "article"]))])
        outer = pick([None, None, ("main", ""), ("div", named(["page", "main", "content"]))])
        for tag, attr in filter(None, (outer, holder)):
            html.append(f"<{tag}{attr}>")
        if chance(0.7):
            block("h1", say(1, 9), 1)
        for _ in range(rng.randint(1, 8)):
            content()
            if chance(0.12):
                part(pick(["ad", "notice", "form", "side", "share"]))
        if chance(0.2):
            part(pick(["comments", "footer", "share", "form"]))
        for tag, _ in filter(None, (holder, outer)):
            html.append(f"</{tag}>")
        for kind in ("comments", "ad", "side", "notice", "form", "footer"):
            if chance(0.45):
                part(kind)
        page = "<html><head><title>x</title><style>p{}</style></head><body>" + "".join(html) + "</body></html>"
        out.append((page, labels))
    return out


def learned(pages: list[tuple[str, list[int]]] | None = None) -> Field:
    return train(examples() if pages is None else pages)


def main_text(html: str | None, field: Field) -> str:
    blocks = leaves(html)
    labels = field.decode([seen for _, seen in blocks])
    return " ".join(text for (text, _), y in zip(blocks, labels) if y)


def extract(pages: DataFrame, field: Field | None = None, keep: list[str] | None = None) -> DataFrame:
    """Adds text and n_chars to each page."""
    small_batches(pages.sparkSession)
    results = ("text", "n_chars")
    names = [c for c in (pages.columns if keep is None else keep) if c not in results]
    sent = pages.sparkSession.sparkContext.broadcast(field or learned())
    schema = T.StructType([*[pages.schema[c] for c in names], T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])

    def run(batches):
        for batch in batches:
            html = batch.column(batch.schema.get_field_index("html"))
            texts = [main_text(h.as_py(), sent.value) for h in html]
            arrays = [batch.column(batch.schema.get_field_index(c)) for c in names]
            yield pa.RecordBatch.from_arrays(
                [*arrays, pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=[*names, *results]
            )

    return pages.select(*dict.fromkeys([*names, "html"])).mapInArrow(run, schema)
