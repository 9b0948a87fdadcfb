"""Labelled pages that the model of html.py is trained on: data-main marks content, data-rest what inside it isn't.

The layouts are written by hand; their words are filler, since the model sees lengths, links and markup only.
"""

from __future__ import annotations

_WORDS = "lorem ipsum dolor sit amet consectetur adipiscing elit sed do eiusmod tempor incididunt ut labore et dolore magna aliqua".split()


def _t(n: int, k: int = 0, end: str = ".") -> str:
    return " ".join(_WORDS[(i * 7 + k) % len(_WORDS)] for i in range(n)).capitalize() + end


def _links(n: int, tag: str = "li", k: int = 0) -> str:
    return "".join(f'<{tag}><a href="/{i}">{_t(1 + (i + k) % 3, i + k, "")}</a></{tag}>' for i in range(n))


def _ps(*sizes: int) -> str:
    return "".join(f"<p>{_t(s, 3 * i)}</p>" for i, s in enumerate(sizes))


_HEAD = "<!DOCTYPE html><html lang='en'><head><title>x</title><style>p{}</style><script>var a='<p>';</script></head><body>"
_FOOT = f"<footer><p>&copy; {_t(4)} <a href='/a'>{_t(2, 1, '')}</a></p><ul>{_links(4)}</ul></footer></body></html>"


def _comments(n: int) -> str:
    return "<section class='comments' id='comments'><h3>Comments</h3>" + "".join(f"<div class='comment'><p class='comment-author'>{_t(2, i, '')}</p><p>{_t(12 + 9 * i, i)}</p></div>" for i in range(n)) + f"<form class='comment-form'><label>{_t(2)}</label><p>{_t(8)}</p></form></section>"


_TABLE = f"<table><tr><th>{_t(2, 0, '')}</th><th>{_t(1, 0, '')}</th></tr><tr><td>{_t(3)}</td><td>{_t(5, 0, '')}</td></tr></table><dl><dt>{_t(2, 0, '')}</dt><dd>{_t(14)}</dd></dl>"

LABELLED = [
    # a bare article with lists of links above and a line below
    _HEAD + f"<nav><ul>{_links(6)}</ul></nav><div class='ad'>{_t(9)}</div><article data-main><h1>{_t(7)}</h1>{_ps(40, 5, 80, 20, 3, 60)}</article><footer>&copy; {_t(5)} &middot; {_t(6)}</footer></body></html>",
    _HEAD + f"<nav>{_links(5, 'div')}</nav><div class='ad'>{_t(16)}</div><article data-main><h1>{_t(4, 0, '')}</h1>{_ps(7, 9, 12)}</article><footer>{_t(8)}</footer></body></html>",
    _HEAD + f"<nav><ul>{_links(5)}</ul></nav><div class='ad'>{_t(7)}</div><article data-main><h1>{_t(3)}</h1><p>{_t(3)}</p></article><footer>{_t(3)}</footer></body></html>",
    # header, sidebar, comments
    _HEAD
    + f"<header class='site-header'><div class='logo'>{_t(2, 0, '')}</div><nav class='menu'><ul>{_links(7)}</ul></nav></header><div class='cookie-notice'><p>{_t(22)}</p></div>"
    + f"<main><article data-main><h1>{_t(8, 0, '')}</h1>{_ps(55, 70)}<h2>{_t(4, 2, '')}</h2><ul><li>{_t(12)}</li><li>{_t(9)}</li><li>{_t(4)}</li></ul><blockquote><p>{_t(30)}</p></blockquote>{_ps(25, 8)}</article>"
    + f"<aside class='sidebar'><h3>{_t(2, 0, '')}</h3><ul>{_links(6)}</ul><p>{_t(18)}</p></aside></main>{_comments(3)}"
    + _FOOT,
    # an article made of divs
    _HEAD
    + f"<div id='header'><div class='top-menu'>{_links(6, 'span')}</div></div><div id='container'><div class='content' data-main><h1>{_t(6, 0, '')}</h1><div class='entry'>{_ps(60, 33, 48)}<div class='advert promo' data-rest><p>{_t(20)}</p></div>{_ps(50, 6)}</div></div>"
    + f"<div id='sidebar' class='widget'><h4>{_t(3, 0, '')}</h4><p>{_t(14)}</p>{_links(5, 'p')}</div></div><div id='footer'><p>{_t(9)}</p></div></body></html>",
    # forms, newsletter, share bars and related links inside the article
    _HEAD
    + f"<header role='banner'><p>{_t(5)}</p></header><nav role='navigation'><ul>{_links(4)}</ul></nav><main role='main'><article class='post' data-main><header><h1>{_t(9, 0, '')}</h1></header>{_ps(42, 51)}<div class='share social' data-rest>{_links(4, 'span')}</div>"
    + f"<form class='newsletter signup' data-rest><p>{_t(14)}</p><label>{_t(2)}</label><button>{_t(1, 0, '')}</button></form><h2>{_t(3, 0, '')}</h2>{_ps(36, 18)}<aside class='related' data-rest><h3>{_t(2, 0, '')}</h3><ul>{_links(4)}</ul></aside>{_ps(29)}</article></main>{_comments(2)}"
    + f"<div class='newsletter'><p>{_t(12)}</p></div>"
    + _FOOT,
    # tables and definition lists are content too
    _HEAD
    + f"<header><nav><ul>{_links(6)}</ul></nav></header><div class='banner ad'><p>{_t(11)}</p></div><main data-main><h1>{_t(5, 0, '')}</h1><p>{_t(28)}</p><table><tr><th>{_t(2, 0, '')}</th><th>{_t(1, 0, '')}</th></tr><tr><td>{_t(3)}</td><td>{_t(5)}</td></tr></table><dl><dt>{_t(2, 0, '')}</dt><dd>{_t(14)}</dd></dl><figure><figcaption>{_t(8)}</figcaption></figure><pre>{_t(10)}</pre><ol><li>{_t(16)}</li><li><p>{_t(11)}</p></li></ol></main>"
    + f"<aside class='widget'><p>{_t(24)}</p></aside><section id='comments' class='comments'><article class='comment'><p>{_t(31)}</p></article><article class='comment reply'><p>{_t(17)}</p></article></section>"
    + _FOOT,
    # a section of the article, notices and breadcrumbs
    _HEAD
    + f"<div class='breadcrumb'>{_links(3, 'span')}</div><div class='notice alert' role='alert'><p>{_t(15)}</p></div><article data-main><h1>{_t(6)}</h1><section>{_ps(45, 38)}</section><section><h2>{_t(4)}</h2>{_ps(12, 64)}</section></article><div class='sponsored ads'><p>{_t(13)}</p></div><div class='popup modal' role='dialog'><p>{_t(10)}</p></div><div class='disclaimer notice'>{_t(21)}</div>"
    + _FOOT,
    # text straight in the article's element
    _HEAD + f"<nav>{_links(3, 'span')}</nav><article data-main><h1>{_t(5)}</h1>{_t(30)}<p>{_t(12)}</p>{_t(9)}</article><div class='comments'><div class='comment'>{_t(20)}</div><div class='comment'>{_t(6)}</div></div><footer>{_t(7)}</footer></body></html>",
    # a body of paragraphs only
    f"<html><body><div data-main><h1>{_t(4)}</h1>{_ps(20, 31, 44)}</div><div class='footer'>{_t(6)}</div></body></html>",
    # one paragraph, or two, in an element or a nest of them, and nothing else on the page
    *[f"{head}<{a} data-main>{''.join(f'<{x}>' for x in inner)}{body}{''.join(f'</{x}>' for x in inner[::-1])}</{a}>{tail}" for head, tail in (("", ""), ("<html><body>", "</body></html>"), ("<body><main>", "</main></body>")) for a in ("article",) for inner in ([], ["div"], ["section", "div"]) for body in (f"<p>{_t(2, 0, '')}</p>", f"<p>{_t(18)}</p>", f"<h1>{_t(4)}</h1><p>{_t(30)}</p>")],
    # an article of many short lines: what a line looks like says little
    *[_HEAD + f"<nav><ul>{_links(5)}</ul></nav><{tag} data-main><h1>{_t(3)}</h1>{_ps(*[1 + i * 5 % 9 for i in range(60)])}<p>{_t(40, 0, '')}</p></{tag.split()[0]}><footer>{_t(6)}</footer></body></html>" for tag in ("article", "div class='content'", "main")],
    # nothing but boilerplate
    _HEAD + f"<nav><ul>{_links(9)}</ul></nav><form class='login'><label>{_t(2)}</label><p>{_t(5)}</p></form><div class='ad'>{_t(12)}</div>" + _FOOT,
    # one page for each pair of names that groups of boilerplate and of content go by
    *[
        _HEAD
        + f"<header><p>{_t(3 + k)}</p></header><div class='{rest}'><h3>{_t(2, k)}</h3><p>{_t(9 + 5 * (k % 5))}</p><p>{_t(24 - k % 7)}</p></div><{tag} class='{main}' data-main><h1>{_t(6)}</h1><p>{_t(20 + k, 1, '' if k % 2 else '.')}</p><h{2 + k % 2}>{_t(4)}</h{2 + k % 2}><p>{_t(48 - k, 0, ',' if k % 3 == 0 else '' if k % 3 == 1 else '.')}</p>{_TABLE if k % 4 == 0 else ''}<ul><li>{_t(9)}</li><li>{_t(4 + k)}</li></ul></{tag}>"
        + f"<div class='{rest}'>{_t(12 + 3 * (k % 4))}</div><section class='{rest}'><p>{_t(5 + k)}</p></section><aside><p>{_t(7 + k)}</p><p>{_t(30 - k)}</p></aside><form><p>{_t(6)}</p><label>{_t(2)}</label></form><div id='{rest}'><div class='inner'><p>{_t(33 - k)}</p><p>{_t(3)}</p></div></div>"
        + _FOOT
        for k, (rest, main, tag) in enumerate(
            zip(
                "comment comments sidebar ad ads advert advertisement promo sponsored newsletter subscribe cookie consent notice alert warning menu nav breadcrumb share social related recommended widget banner popup modal footer header login signup search reply respond disclaimer copyright pagination tags".split(),
                ("content article post entry main story body text".split() * 5)[:38],
                (["div", "article", "main", "section"] * 10)[:38],
                strict=True,
            )
        )
    ],
]
