"""HTML extraction: a linear-chain conditional random field over DOM leaf blocks, decoded by Viterbi.

A page is cut at block elements into leaf blocks of text, in page order. Features of a block are its tag, its ancestors'
tags and the words of their class, id and role, and its text (length, links, punctuation, signs). Labels are main text
or not; features also see the neighbours, and the chain carries what stands together. The field is trained on labelled
pages, which ``labelled_pages`` writes from a seed: layouts of articles with menus, headers, footers, sidebars, notices,
adverts, forms and reader comments, in semantic and plain markup.

Scripts, styles, markup and comments are never text. Character references are decoded, white space inside a block
becomes one space, and main blocks are joined by two line ends. A map without a shuffle; a page is parsed in time linear
in its length. Defined cases: null or empty html gives an empty text; a page cut short ends its open elements; rows that
repeat are extracted each; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import runtime
from .toxicity import Field, Tokens

TAG = re.compile(r"""<(?:!--.*?(?:-->|\Z)|[!?][^>]*(?:>|\Z)|(/?)([A-Za-z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*+)(?:>|\Z))""", re.S)
NAMES = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")

#: Elements whose content isn't page text.
RAW = {"script", "style", "template", "iframe", "textarea", "select", "title"}
#: Elements that begin and end a block.
BLOCKS = {
    "address", "article", "aside", "blockquote", "body", "caption", "center", "dd", "details", "dialog", "div", "dl", "dt", "fieldset",
    "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "head", "header", "hgroup", "hr", "html", "legend", "li",
    "main", "menu", "nav", "noscript", "ol", "p", "pre", "search", "section", "summary", "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul",
}
#: What an opening tag ends, if it is open below.
ENDS = {"p": {"p"}, "li": {"li", "p"}, "dt": {"dt", "dd", "p"}, "dd": {"dt", "dd", "p"}, "tr": {"tr", "td", "th", "p"}, "td": {"td", "th", "p"}, "th": {"td", "th", "p"}}
VOID = {"hr"}
BITS = 16
STEPS, RATE, PENALTY = 80, 0.4, 1e-4
TRAINING_PAGES = 400


@dataclass
class Block:
    text: str
    path: tuple[tuple[str, tuple[str, ...]], ...]
    links: int


def blocks(page: str) -> list[Block]:
    """The leaf blocks of a page, in order."""
    out: list[Block] = []
    stack: list[tuple[str, tuple[str, ...]]] = []
    text: list[str] = []
    links = depth = 0

    def flush() -> None:
        nonlocal links
        joined = "".join(text)
        if "&" in joined:
            joined = html.unescape(joined)
        joined = " ".join(joined.split())
        if joined:
            out.append(Block(joined, tuple(stack), links))
        text.clear()
        links = 0

    def add(piece: str) -> None:
        nonlocal links
        text.append(piece)
        if depth:
            links += len(piece)

    at, n = 0, len(page)
    while at < n:
        m = TAG.search(page, at)
        if not m:
            rest = page[at:]
            cut = rest.rfind("<")
            add(rest[:cut] if cut >= 0 and re.match(r"<[/A-Za-z!?]", rest[cut:]) else rest)
            break
        if m.start() > at:
            add(page[at : m.start()])
        at, name = m.end(), (m[2] or "").lower()
        if not name:
            continue
        if name in RAW and not m[1]:
            if not m[3].endswith("/") or name in ("script", "style", "textarea", "title"):
                end = re.compile(rf"</{name}\b[^>]*(?:>|\Z)", re.I).search(page, at)
                at = end.end() if end else n
            continue
        if name == "a":
            depth = max(0, depth + (-1 if m[1] else 1))
        elif name in ("br", "wbr", "img", "input"):
            text.append(" " if name != "wbr" else "")
        elif name in BLOCKS:
            flush()
            depth = 0
            if m[1]:
                for i in range(len(stack) - 1, -1, -1):
                    if stack[i][0] == name:
                        del stack[i:]
                        break
            else:
                while stack and stack[-1][0] in ENDS.get(name, ()):
                    stack.pop()
                if name not in VOID:
                    words = tuple(sorted({w.lower() for g in NAMES.findall(m[3]) for w in WORDS.findall("".join(g))})) if m[3] else ()
                    stack.append((name, words))
    flush()
    return out


@lru_cache(1 << 16)
def _number(feature: str) -> int:
    return crc32(feature.encode()) & ((1 << BITS) - 1)


@lru_cache(1 << 14)
def _path_features(path: tuple[tuple[str, tuple[str, ...]], ...]) -> tuple[int, ...]:
    found = {f"in:{t}" for t, _ in path} | {f"has:{w}" for _, words in path for w in words} | {f"near:{w}" for _, words in path[-1:] for w in words}
    found.add(f"tag:{path[-1][0] if path else ''}")
    found.add(f"pair:{'>'.join(t for t, _ in path[-2:])}")
    return tuple(map(_number, sorted(found)))


def _text_features(b: Block) -> list[int]:
    n, text = len(b.text), b.text
    words = text.count(" ") + 1
    share = b.links / n
    out = [f"words:{min(7, words.bit_length())}", f"links:{0 if not share else 1 if share < 0.5 else 2}", f"end:{text[-1] if text[-1] in '.!?:;,' else ''}"]
    out += [f"stops:{min(3, sum(text.count(c) for c in '.!?'))}"]
    out += [f"sign:{c}" for c in "©|»›·@#" if c in text]
    if text[0].islower():
        out.append("lower")
    return [_number(f) for f in out]


def features(found: list[Block]) -> tuple[np.ndarray, np.ndarray]:
    """(block, feature number) pairs of one page."""
    own = [[*_path_features(b.path), *_text_features(b)] for b in found]
    row, feature = [], []
    for i, mine in enumerate(own):
        side = [_number(f"before:{found[i - 1].path[-1][0] if found[i - 1].path else ''}") if i else _number("first")]
        side.append(_number(f"after:{found[i + 1].path[-1][0] if found[i + 1].path else ''}") if i + 1 < len(own) else _number("last"))
        feature += [*mine, *side]
        row += [i] * (len(mine) + 2)
    return np.array(row, np.int64), np.array(feature, np.int64)


def _chain(sizes: list[int]) -> Tokens:
    none, size = np.zeros(0, np.int64), np.array(sizes, np.int64)
    return Tokens(none, none, none, none, none, np.cumsum(size) - size, size)


def fit(pages: list[tuple[list[Block], list[int]]]) -> Field:
    """Gradient steps on the exact log-likelihood of labelled pages."""
    row, feature, label, sizes, base = [], [], [], [], 0
    for found, labels in pages:
        r, f = features(found)
        row.append(r + base)
        feature.append(f)
        label += labels
        sizes.append(len(found))
        base += len(found)
    row, feature, y = np.concatenate(row), np.concatenate(feature), np.array(label, np.float64)
    t = _chain(sizes)
    field = Field(np.zeros(1 << BITS), 0.0, np.zeros((2, 2)))
    pair = np.ones(len(y), bool)
    pair[t.first] = False
    pair = np.flatnonzero(pair)
    squares, move_squares = np.full(1 << BITS, 1e-8), np.full((2, 2), 1e-8)
    for _ in range(STEPS):
        unary = np.bincount(row, field.weights[feature], len(y)) + field.bias
        forward, backward = field.chains(t, unary)
        p = 1 / (1 + np.exp(-np.clip(forward + backward, -60, 60)))
        gradient = np.bincount(feature, (p - y)[row], 1 << BITS) / len(y) * 100 + PENALTY * field.weights
        f, s, m = forward[pair - 1], unary[pair] + backward[pair], field.moves
        joint = np.stack([m[0, 0] + 0 * f, s + m[0, 1], f + m[1, 0], f + s + m[1, 1]])
        joint = np.exp(joint - joint.max(0))
        joint /= joint.sum(0)
        seen = np.bincount((2 * y[pair - 1] + y[pair]).astype(int), minlength=4)
        moves = ((joint.sum(1) - seen) / len(y) * 100).reshape(2, 2) + PENALTY * m
        squares += gradient**2
        move_squares += moves**2
        field.weights = field.weights - RATE * gradient / np.sqrt(squares)
        field.moves = m - 0.2 * RATE * moves / np.sqrt(move_squares)
    return field


def viterbi(field: Field, unary: np.ndarray) -> list[bool]:
    """The best labelling of one page's blocks."""
    (a, b), (c, d) = field.moves.tolist()
    back, off, on = [], 0.0, float(unary[0])
    for u in unary[1:].tolist():
        stay, go = off + a >= on + c, on + d >= off + b
        back.append((not stay, go))
        off, on = max(off + a, on + c), max(on + d, off + b) + u
    label = [on > off]
    for from_on, on_from_on in reversed(back):
        label.append(on_from_on if label[-1] else from_on)
    return label[::-1]


def main_text(page: str | None, field: Field) -> str:
    found = blocks(page) if page else []
    if not found:
        return ""
    row, feature = features(found)
    keep = viterbi(field, np.bincount(row, field.weights[feature], len(found)) + field.bias)
    return "\n\n".join(b.text for b, k in zip(found, keep, strict=True) if k)


def labelled_pages(count: int = TRAINING_PAGES, seed: int = 5) -> list[tuple[list[Block], list[int]]]:
    """Training pages and the label of each of their blocks. Main text is marked by a sign that is taken off again."""
    rng = np.random.default_rng(seed)
    mark = "\x01"
    syllables = ["an", "ber", "cho", "de", "en", "fil", "ga", "ho", "in", "ka", "lo", "mer", "no", "or", "pa", "qui", "ra", "sol", "ti", "un", "ve", "wa", "ya", "zu"]

    def pick(*options: str) -> str:
        return options[int(rng.integers(len(options)))]

    def words(low: int, high: int) -> str:
        return " ".join("".join(rng.choice(syllables, int(rng.integers(1, 5)))) for _ in range(int(rng.integers(low, high + 1))))

    def sentence(low: int = 3, high: int = 18) -> str:
        return words(low, high).capitalize() + pick(".", ".", ".", "!", "?", "")

    def prose(n: int, sign: str = "") -> str:
        body = " ".join(sentence() for _ in range(n))
        if rng.random() < 0.15:
            body += f' <a href="/{words(1, 1)}">{words(1, 3)}</a> {words(1, 4)}.'
        if rng.random() < 0.15:
            body = f"<b>{words(1, 3)}</b> {body}"
        return sign + body.replace(". ", ".<br>", int(rng.random() < 0.1))

    def menu(name: str, n: int) -> str:
        items = "".join(f'<li><a href="/{words(1, 1)}">{words(1, 2)}</a></li>' for _ in range(n))
        return pick(f"<nav{name}><ul>{items}</ul></nav>", f"<div{name}><ul>{items}</ul></div>", f"<ul{name}>{items}</ul>") if name else f"<nav><ul>{items}</ul></nav>"

    def named(*options: str) -> str:
        return f' {pick("class", "class", "id")}="{pick(*options)}"'

    def aside(kind: str) -> str:
        length = int(rng.integers(1, 4))
        match kind:
            case "ad":
                return f"<{pick('div', 'aside')}{named('ad', 'ads', 'advert', 'advertisement', 'sponsored', 'ad-box', 'promo', 'banner-ad')}>{pick('', '<p>')}{prose(length)}</div>"
            case "notice":
                return f"<div{named('notice', 'cookie', 'cookie-notice', 'consent', 'gdpr', 'newsletter', 'popup', 'alert', 'banner', 'subscribe')}><p>{prose(length)}</p></div>"
            case "sidebar":
                tag = pick("aside", "div")
                body = f"<h3>{words(1, 3)}</h3>" + pick(menu(" class='links'", 4), f"<p>{prose(length)}</p>")
                return f"<{tag}{named('sidebar', 'related', 'widget', 'side', 'recommended', 'share', 'social') if tag == 'div' or rng.random() < 0.5 else ''}>{body}</{tag}>"
            case "form":
                return f"<form{pick('', named('search', 'signup', 'login'))}><label>{words(1, 3)}</label><p>{prose(1)}</p><input name=q><button>{words(1, 2)}</button></form>"
            case "comments":
                n, tag = int(rng.integers(1, 5)), pick("section", "div")
                one = lambda: f"<{pick('div', 'li', 'article')}{named('comment', 'reply', 'comment-body', 'user-comment')}><p>{prose(int(rng.integers(1, 4)))}</p></div>"
                return f"<{tag}{named('comments', 'comment-list', 'discussion', 'responses', 'reader-comments')}><h2>{words(1, 2)}</h2>{''.join(one() for _ in range(n))}</{tag}>"
            case "header":
                return f"<header{pick('', named('site-header', 'top', 'masthead'))}><div>{words(1, 3)}</div><p>{words(2, 6)}</p></header>"
            case "footer":
                tag = pick("footer", "footer", "div")
                return f"<{tag}{named('footer', 'site-footer', 'copyright', 'bottom') if tag == 'div' else ''}>{pick('', '<p>')}&copy; {words(1, 2)} &middot; {prose(length)}</{tag}>"
        return menu(pick("", named("menu", "nav", "navbar", "breadcrumbs", "navigation", "tabs")), int(rng.integers(2, 8)))

    def article() -> str:
        parts = [f"<{(h := pick('h1', 'h1', 'h2'))}>{mark}{words(1, 14)}</{h}>"]
        for _ in range(int(rng.integers(1, 12))):
            n, close = int(rng.integers(1, 7)), pick("</p>", "</p>", "")
            x = rng.random()
            if x < 0.72:
                parts.append(f"<p>{prose(n, mark)}{close}")
            elif x < 0.8:
                parts.append(f"<h{pick('2', '3')}>{mark}{words(1, 6)}</h2>")
            elif x < 0.86:
                parts.append("<ul>" + "".join(f"<li>{mark}{sentence(1, 10)}</li>" for _ in range(n)) + "</ul>")
            elif x < 0.9:
                parts.append(f"<blockquote>{pick('', '<p>')}{prose(n, mark)}</blockquote>")
            elif x < 0.93:
                parts.append(f"<table><tr><td>{mark}{words(1, 3)}</td><td>{mark}{words(1, 3)}</td></tr></table>")
            elif x < 0.96:
                parts.append(f"<pre>{mark}{words(2, 12)}</pre>")
            else:
                parts.append(f"<div>{prose(n, mark)}</div>")
            if rng.random() < 0.06:
                parts.append(aside(pick("ad", "notice", "sidebar", "form")))
        body = "".join(parts)
        plain = f"<div{named('content', 'post', 'entry-content', 'article-body', 'story', 'main')}>{body}</div>"
        return pick(f"<article>{body}</article>", f"<article>{body}</article>", f"<main>{body}</main>", f"<main><article>{body}</article></main>", plain)

    out = []
    for _ in range(count):
        before = [aside(pick("header", "menu", "menu", "ad", "notice", "form")) for _ in range(int(rng.integers(0, 4)))]
        after = [aside(pick("comments", "comments", "sidebar", "ad", "form", "menu")) for _ in range(int(rng.integers(0, 4)))]
        page = f"<html><head><title>{words(2, 6)}</title></head><body>{''.join(before)}{article()}{''.join(after)}{aside('footer') if rng.random() < 0.85 else ''}</body></html>"
        found = blocks(page)
        labels = [int(mark in b.text) for b in found]
        for b in found:
            b.text = " ".join(b.text.replace(mark, " ").split()) or "x"
        out.append((found, labels))
    return out


def extract(df: DataFrame, field: Field, id_column: str = "page_id", html_column: str = "html", *columns: str) -> DataFrame:
    """One row per input row: its id, the further columns, text and n_chars."""
    shared = df.sparkSession.sparkContext.broadcast(field)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            text = [main_text(h, own) for h in batch["_html"].to_pylist()]
            kept = [c for c in batch.schema.names if c != "_html"]
            arrays = [batch[c] for c in kept] + [pa.array(text, pa.string()), pa.array([len(t) for t in text], pa.int64())]
            yield pa.RecordBatch.from_arrays(arrays, [*kept, "text", "n_chars"])

    wanted = [id_column, *columns]
    kinds = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in wanted)
    return df.select(*wanted, F.col(html_column).alias("_html")).mapInArrow(run, f"{kinds}, text string, n_chars bigint")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(runtime.table(spark, sf_dir, "pages"), fit(labelled_pages()), "page_id", "html", "url")
