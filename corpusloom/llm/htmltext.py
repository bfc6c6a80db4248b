"""Main text of web pages by a linear-chain conditional random field over DOM leaf blocks.

A page is read into leaf blocks: the text between two block-level tags, with
its chain of open elements. Each block has features of its ancestors (tags,
class and id words) and of its text (length, links, punctuation). A two-state
chain (main text or not) scores blocks and neighbours; Viterbi's best path
chooses the blocks of the article.

The chain is trained by maximum likelihood (forward-backward, AdaGrad) on
labelled pages that :func:`labelled_pages` lays out from a fixed seed in many
styles: article or plain containers, menus, side bars, notices, adverts
inside the article, forms, and reader comments that read like prose. Training
needs no input table, takes a bounded number of pages and gives a few hundred
weights, which travel with the tasks.

Defined cases: null, empty or textless pages give an empty text; unclosed and
stray tags are closed as browsers do for paragraphs, items, cells and heads, and
the end tag of an element without text closes what is open inside it; pages of
any length are read in one pass; repeated rows give equal rows; an empty table
gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import html as entities
import math
import random
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from .shared import read_table

BLOCK_TAGS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul".split()
)
#: Elements whose content is never text of the page.
SILENT = frozenset("script style noscript template textarea select option title head iframe object svg math canvas button datalist".split())
RAW = frozenset("script style textarea title iframe".split())
#: What an open head holds; any other tag, or text, ends it, as its omitted end tag would.
HEAD_TAGS = frozenset("html head title base basefont bgsound link meta style script noscript noframes template".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: An opening tag closes an open element of these kinds first.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SCOPES = frozenset("ul ol dl table div article section main aside nav body form".split())
CONTAINERS = frozenset("article main section aside nav header footer form div dialog body".split())
_NAME = re.compile(r"/?([a-zA-Z][a-zA-Z0-9:-]*)")
_ATTR = re.compile(r"""\b(?:class|id|role|itemprop)\s*=\s*("[^"]*"|'[^']*'|[^\s>]+)""", re.I)
_WORD = re.compile(r"[a-z]+")


@dataclass
class Block:
    text: str
    tags: tuple
    names: frozenset
    linked: int
    container: str
    own: frozenset
    box: int


#: What lies between a tag's name and its '>': a '>' in a quoted value ends nothing, and a quote that never closes quotes nothing.
_TAG_REST = re.compile(r"""(?:[^>=]++|=\s*+(?:"[^"]*+"|'[^']*+'|[^\s>]*+))*+>""")


def _tag_end(page: str, at: int) -> int:
    """The index of the '>' that ends the tag whose name ends at ``at``, or -1."""
    end = page.find(">", at)
    if end < 0 or page.find("=", at, end) < 0:
        return end
    found = _TAG_REST.match(page, at)
    return found.end() - 1 if found else -1


def leaf_blocks(page: str | None) -> list[Block]:
    """The leaf blocks of a page in order."""
    page = page or ""
    lower = None
    blocks: list[Block] = []
    stack: list[tuple[str, frozenset, int]] = []
    held: list[str] = []
    linked = silent = links = 0

    def close_block() -> None:
        nonlocal linked
        if held:
            text = " ".join(entities.unescape("".join(held)).split())
            if text:
                near = next((x for x in reversed(stack) if x[0] in CONTAINERS), ("none", frozenset(), 0))
                blocks.append(Block(text, tuple(t for t, _, _ in stack), frozenset(w for _, n, _ in stack for w in n), linked, *near))
            held.clear()
        linked = 0

    def pop(to: int) -> None:
        nonlocal silent, links
        for name, _, _ in stack[to:]:
            silent -= name in SILENT
            links -= name == "a"
        del stack[to:]

    at, size = 0, len(page)
    while at < size:
        tag = page.find("<", at)
        if tag < 0:
            tag = size
        if silent and stack[-1][0] == "head" and page[at:tag].strip():
            pop(len(stack) - 1)
        if tag > at and not silent:
            held.append(page[at:tag])
            if links:
                linked += tag - at
        if tag == size:
            break
        if page.startswith("<!--", tag):
            end = page.find("-->", tag + 4)
            at = size if end < 0 else end + 3
            continue
        name = _NAME.match(page, tag + 1)
        if not name:
            if page[tag + 1 : tag + 2] in ("!", "?"):
                end = page.find(">", tag)
                at = size if end < 0 else end + 1
            else:
                if not silent:
                    held.append("<")
                at = tag + 1
            continue
        end = _tag_end(page, name.end())
        if end < 0:
            break
        kind, closing, body = name.group(1).lower(), page[tag + 1] == "/", page[name.end() : end]
        at = end + 1
        if kind in BLOCK_TAGS:
            close_block()
        elif kind == "br" and not silent:
            held.append(" ")
        if closing:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == kind:
                    pop(k)
                    break
                if kind not in BLOCK_TAGS and kind not in SILENT and stack[k][0] in BLOCK_TAGS:
                    break
            continue
        if kind == "head" and any(t == "head" for t, _, _ in stack):
            continue
        if silent and (kind == "body" or stack[-1][0] == "head" and kind not in HEAD_TAGS):
            for k, (name, _, _) in enumerate(stack):
                if name == "head":
                    pop(k)
                    break
        if kind in VOID or body.endswith("/") and kind not in RAW:
            continue
        if kind in BLOCK_TAGS:
            # a block ends an open paragraph, and what was open inside it
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == "p":
                    pop(k)
                    break
                if stack[k][0] in SCOPES:
                    break
        if kind in CLOSES:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] in CLOSES[kind]:
                    pop(k)
                    break
                if stack[k][0] in SCOPES:
                    break
        found = frozenset(w for m in _ATTR.findall(body) for w in _WORD.findall(m.lower())) if "=" in body else frozenset()
        stack.append((kind, found, tag + 1))
        silent += kind in SILENT
        links += kind == "a"
        if kind in RAW:
            lower = page.lower() if lower is None else lower
            if len(lower) != size:  # a character whose lower case is longer
                lower = re.sub("[A-Z]", lambda m: m.group().lower(), page)
            stop = lower.find("</" + kind, at)
            at = size if stop < 0 else stop
    close_block()
    return blocks


def features(blocks: list[Block]) -> list[list[str]]:
    """The active features of every block."""
    out = []
    shares: dict[int, int] = {}
    for b in blocks:
        shares[b.box] = shares.get(b.box, 0) + len(b.text) - min(len(b.text), b.linked)
    total = max(1, sum(shares.values()))
    largest = max(shares.values(), default=0)
    for b in blocks:
        n = len(b.text)
        tags = set(b.tags)
        inner = next((t for t in reversed(b.tags) if t in BLOCK_TAGS), "none")
        f = ["bias", "in:" + inner, f"len:{min(8, int(math.log2(n + 1)))}", f"link:{min(4, 4 * b.linked // max(1, n))}"]
        f += ["anc:" + t for t in tags if t in BLOCK_TAGS and t not in ("html", "body")]
        f += ["name:" + w for w in b.names if len(w) > 1]
        f += {"stem:" + w[:4] for w in b.names if len(w) > 3}
        f += [f"share:{4 * shares[b.box] // total}", "largest" if shares[b.box] == largest else "smaller"]
        f.append("box:" + b.container + ("" if b.own else ":bare"))
        f.append("boxes:" + ">".join([t for t in b.tags if t in CONTAINERS][-2:]))
        f += ["own:" + w for w in b.own if len(w) > 1]
        f.append("end:" + ("stop" if b.text[-1] in ".!?:;\"'»”)" else "open"))
        if "©" in b.text:
            f.append("copyright")
        commas = b.text.count(",")
        f.append(f"commas:{min(3, commas)}")
        if sum(map(str.isdigit, b.text)) * 4 > n:
            f.append("digits")
        if not tags & {"article", "main"}:
            f.append("outside")
        out.append(f)
    return out


@dataclass
class Chain:
    """Weights of the two-state chain: per feature (not main, main), and per transition."""

    weights: dict
    moves: list

    def scores(self, rows: list[list[str]]) -> list[tuple[float, float]]:
        get, none = self.weights.get, (0.0, 0.0)
        out = []
        for row in rows:
            a = b = 0.0
            for f in row:
                w = get(f, none)
                a += w[0]
                b += w[1]
            out.append((a, b))
        return out

    def decode(self, rows: list[list[str]]) -> list[int]:
        """Viterbi's best path."""
        if not rows:
            return []
        (t00, t01), (t10, t11) = self.moves
        scores = self.scores(rows)
        a, b = scores[0]
        back = []
        for s0, s1 in scores[1:]:
            x = (a + t00, b + t10)
            y = (a + t01, b + t11)
            back.append((int(x[1] > x[0]), int(y[1] > y[0])))
            a, b = max(x) + s0, max(y) + s1
        path = [int(b > a)]
        for step in reversed(back):
            path.append(step[path[-1]])
        return path[::-1]


def train(pages: list[tuple[list[list[str]], list[int]]], rounds: int = 25, rate: float = 0.4, ridge: float = 1e-5, seed: int = 7) -> Chain:
    """Maximum likelihood of the labelled chains by AdaGrad on the exact gradient of each page."""
    rng = random.Random(seed)
    names = {f: i for i, f in enumerate(sorted({f for rows, _ in pages for row in rows for f in row}))}
    w, m = np.zeros((len(names), 2)), np.zeros((2, 2))
    gw, gm = np.full_like(w, 1e-6), np.full_like(m, 1e-6)
    data = [([np.array([names[f] for f in row]) for row in rows], np.array(y)) for rows, y in pages if rows]
    for _ in range(rounds):
        rng.shuffle(data)
        for rows, y in data:
            s = np.stack([w[r].sum(0) for r in rows])
            n = len(rows)
            alpha, beta = np.zeros((n, 2)), np.zeros((n, 2))
            alpha[0] = s[0]
            for k in range(1, n):
                alpha[k] = s[k] + np.logaddexp(alpha[k - 1, 0] + m[0], alpha[k - 1, 1] + m[1])
            for k in range(n - 2, -1, -1):
                z = m + s[k + 1] + beta[k + 1]
                beta[k] = np.logaddexp(z[:, 0], z[:, 1])
            total = np.logaddexp(alpha[-1, 0], alpha[-1, 1])
            node = np.exp(alpha + beta - total)
            node[np.arange(n), y] -= 1
            dm = np.zeros((2, 2))
            for k in range(n - 1):
                dm += np.exp(alpha[k][:, None] + m + s[k + 1] + beta[k + 1] - total)
                dm[y[k], y[k + 1]] -= 1
            dw = np.zeros_like(w)
            for r, g in zip(rows, node):
                dw[r] += g
            dw += ridge * w
            gw += dw * dw
            gm += dm * dm
            w -= rate * dw / np.sqrt(gw)
            m -= rate * dm / np.sqrt(gm)
    return Chain({f: (float(w[i, 0]), float(w[i, 1])) for f, i in names.items()}, m.tolist())


def labelled_pages(count: int = 800, seed: int = 11) -> list[tuple[str, list[str]]]:
    """(html, main text blocks) of invented pages in many layouts."""
    rng = random.Random(seed)

    def word() -> str:
        return "".join(rng.choice("abdefgilmnoprstuéäñ") for _ in range(rng.randint(2, 9)))

    def phrase(low: int, high: int) -> str:
        return " ".join(word() for _ in range(rng.randint(low, high))).capitalize()

    def prose(sentences: int) -> str:
        return " ".join(phrase(4, 16).replace(" ", ", " if rng.random() < 0.3 else " ", 1) + rng.choice("....!?") for _ in range(sentences))

    def links(tag: str = "li") -> str:
        return "".join(f'<{tag}><a href="/{word()}">{phrase(1, 3)}</a></{tag}>' for _ in range(rng.randint(3, 8)))

    def named(*names: str) -> str:
        return f'{rng.choice(["class", "class", "id", "role"])}="{rng.choice(names)}{rng.choice(["", "", "-" + word(), " " + word()])}"'

    def boiler(kind: str) -> str:
        short = prose(rng.randint(1, 2)) if rng.random() < 0.7 else phrase(1, 6)
        inner = rng.choice(["{}", "<p>{}</p>", "<h3>{1}</h3><p>{0}</p>", "<p>{}</p><p>{1}</p>"])
        wrapped = lambda text: inner.replace("{}", "{0}").format(text, phrase(1, 6))
        if kind == "nav":
            return rng.choice([f"<nav><ul>{links()}</ul></nav>", f'<div {named("menu", "nav", "navigation", "navbar", "breadcrumb", "breadcrumbs", "main-menu", "site-nav", "topnav", "links")}><ul>{links()}</ul></div>', f"<nav>{links('span')}</nav>"])
        if kind == "header":
            return rng.choice([f"<header><div {named('logo', 'site-title', 'branding')}>{phrase(1, 3)}</div><p>{phrase(2, 7)}</p></header>", f"<header><h1>{phrase(1, 3)}</h1></header>", f'<div {named("header", "masthead", "top-bar", "site-header", "page-header", "branding")}>{phrase(1, 4)}</div>'])
        if kind == "footer":
            return rng.choice([f"<footer>&copy; {word()}.example &middot; {short}</footer>", f"<footer><p>{short}</p><ul>{links()}</ul></footer>", f'<div {named("footer", "copyright", "colophon", "site-footer", "bottom", "legal")}><p>© {word()} {short}</p></div>'])
        if kind == "side":
            return rng.choice([f"<aside><h2>{phrase(1, 3)}</h2><ul>{links()}</ul><p>{short}</p></aside>", f'<div {named("sidebar", "side", "widget", "related", "recommended", "trending", "related-posts", "side-bar", "most-read", "popular", "more-stories")}><h3>{phrase(1, 3)}</h3><p>{prose(2)}</p><ul>{links()}</ul></div>', f"<aside><p>{prose(rng.randint(1, 3))}</p></aside>"])
        if kind == "notice":
            return f'<{(t := rng.choice(["div", "section", "div", "aside"]))} {named("cookie", "cookie-notice", "notice", "banner", "consent", "gdpr", "alert", "newsletter", "subscribe", "paywall", "privacy", "cookie-banner", "cookies", "popup", "modal", "signup", "warning", "disclaimer", "notification")}>{wrapped(prose(rng.randint(1, 3)))}</{t}>'
        if kind == "ad":
            return f'<{(t := rng.choice(["div", "aside", "section", "div"]))} {named("ad", "ads", "advert", "advertisement", "sponsored", "promo", "ad-slot", "sponsor", "adbox", "advertising", "ad-container", "banner-ad", "sponsored-content", "promotion")}>{wrapped(prose(rng.randint(1, 3)) if rng.random() < 0.8 else phrase(1, 4))}</{t}>'
        if kind == "form":
            return rng.choice([f"<form action=/><label>{phrase(1, 3)}</label><input name=q><p>{short}</p><button>{word()}</button></form>", f"<form><fieldset><legend>{phrase(1, 3)}</legend><label>{phrase(2, 6)}</label></fieldset></form>"])
        if kind == "toc":
            listed = f"<ul>{links()}</ul>"
            return rng.choice([listed, f'<{(t := rng.choice(["ul", "ol"]))} {named("toc", "contents", "jump-links", "table-of-contents")}>{links()}</{t}>', f'<div {named("toc", "contents", "table-of-contents")}><h2>{phrase(1, 3)}</h2>{listed}</div>', f"<nav>{listed}</nav>"])
        if kind == "comments":
            each = "".join(f'<{(t := rng.choice(["div", "li", "article"]))} class="comment"><p {named("author", "meta", "user")}>{phrase(1, 2)}</p><p>{prose(rng.randint(1, 5))}</p></{t}>' for _ in range(rng.randint(1, 5)))
            return f'<{(t := rng.choice(["section", "div", "ol"]))} {named("comments", "comment-list", "responses", "discussion", "replies", "reader-comments", "comment-section", "user-comments", "disqus", "feedback")}><h2>{phrase(1, 2)}</h2>{each}</{t}>'
        return f'<div {named("share", "social", "tags", "meta", "byline", "pagination", "pager", "toolbar")}>{phrase(1, 5)}</div>'

    kinds = ["nav", "header", "footer", "side", "notice", "ad", "form", "comments", "share"]
    pages = []
    for _ in range(count):
        main: list[str] = []

        headed = False

        def body() -> str:
            out = []
            if rng.random() < 0.85:
                main.append(phrase(2, 12) + rng.choice(["", "."]))
                title = f"<h1>{main[-1]}</h1>"
                # the headline of an article's own header is the article's; a byline in it isn't
                out.append(f"<header>{title}{rng.choice(['', boiler('share')])}</header>" if headed and rng.random() < 0.3 else title)
            if rng.random() < 0.1:
                out.append(boiler("toc"))
            for _ in range(rng.randint(1, 9)):
                r = rng.random()
                if r < 0.62:
                    text = prose(rng.randint(1, 6)) if rng.random() < 0.85 else phrase(1, rng.choice([1, 1, 5])) + rng.choice(["", ".", "."])
                    # not all prose ends in a full stop
                    main.append(text if rng.random() < 0.6 else text.rstrip(".!?") + rng.choice(["", "", "***", " #", "%", ","]))
                    out.append(rng.choice(["<p>{}</p>", "<p>{}</p>", "<p>{}", "<p><b>{}<br>", "<p {}>".format(named("lead", "intro", "text")) + "{}</p>"]).format(main[-1]))
                elif r < 0.70:
                    main.append(phrase(1, 6))
                    out.append(f"<{(t := rng.choice(['h2', 'h3']))}>{main[-1]}</{t}>")
                elif r < 0.75:
                    items = [phrase(2, 12) + rng.choice(["", "."]) for _ in range(rng.randint(2, 5))]
                    main.extend(items)
                    out.append("<ul>" + "".join(f"<li>{x}</li>" for x in items) + "</ul>")
                elif r < 0.78:
                    main.append(prose(2))
                    out.append(f"<{(t := rng.choice(['blockquote', 'pre', 'figcaption']))}>{main[-1]}</{t}>")
                elif r < 0.81:
                    cells = [phrase(1, 3) for _ in range(4)]
                    main.extend(cells)
                    out.append("<table><tr>" + "".join(f"<td>{x}</td>" for x in cells) + "</tr></table>")
                else:
                    out.append(boiler(rng.choice(["ad", "ad", "share", "notice", "side", "form", "comments", "toc"])))
            if rng.random() < 0.15:
                out.append(boiler("comments"))
            return "".join(out)

        bare = rng.random() < 0.1
        inside = "{}" if bare else rng.choice([
            "<article>{}</article>", "<article>{}</article>", "<main>{}</main>", "<main><article>{}</article></main>",
            '<div class="content">{}</div>', '<div id="main-content">{}</div>', '<div class="post"><div class="entry">{}</div></div>',
            '<div class="article-body">{}</div>', '<section class="story">{}</section>', "<div>{}</div>", "{}",
        ])
        headed = "<article>" in inside or "<main>" in inside
        inside = inside.format(body())
        above = [] if bare else [boiler(k) for k in rng.sample(["nav", "header", "notice", "ad", "form", "share", "side"], rng.randint(0, 4))]
        below = [] if bare else [boiler(k) for k in rng.sample(kinds, rng.randint(0, 5))]
        pages.append((f"<html><head><title>{phrase(2, 6)}</title><script>var a='<p>';</script></head><body>{''.join(above)}{inside}{''.join(below)}</body></html>", list(main)))
    return pages


def labelled_blocks(page: str, main: list[str]) -> tuple[list[list[str]], list[int]]:
    """Features and labels of a page whose main blocks are known in order."""
    blocks, labels, at = leaf_blocks(page), [], 0
    for b in blocks:
        hit = at < len(main) and b.text == " ".join(main[at].split())
        labels.append(int(hit))
        at += hit
    return features(blocks), labels


_MODEL: list[Chain] = []


def model() -> Chain:
    """The chain trained on the labelled pages (once for each driver)."""
    if not _MODEL:
        _MODEL.append(train([labelled_blocks(p, m) for p, m in labelled_pages()]))
    return _MODEL[0]


def main_text(page: str | None, chain: Chain) -> str:
    blocks = leaf_blocks(page)
    return "\n".join(b.text for b, y in zip(blocks, chain.decode(features(blocks))) if y)


def extract(pages: DataFrame, chain: Chain | None = None) -> DataFrame:
    """page_id, url, text, n_chars of every page."""
    chain = chain or model()
    kept = pages.select("page_id", "url", "html")
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in kept.schema.fields[:2])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            text = [main_text(page, chain) for page in batch["html"]]
            yield batch[["page_id", "url"]].assign(text=text, n_chars=[len(t) for t in text])

    return kept.mapInPandas(run, kinds + ", text string, n_chars long")


def op9_html_text(spark, sf_dir: str) -> DataFrame:
    return extract(read_table(spark, sf_dir, "pages"))
