"""Labelled pages for the HTML extractor: made by rule from layouts, each piece of main text between <x-main> and </x-main>."""

from __future__ import annotations

import random

#: Class, id and role words of what is not main text, by kind of element that carries them here.
BOILERPLATE = {
    "div": "ad ads advert advertisement adbox banner sponsor sponsored promo promotion cookie cookies consent gdpr notice alert popup modal overlay newsletter subscribe signup share sharing social related recommended recommendations popular trending teaser sidebar widget menu nav navbar navigation breadcrumb breadcrumbs header masthead topbar footer copyright legal disclaimer comment comments reply replies respond disqus discussion login search toolbar pagination pager tags skip rail paywall complementary contentinfo",
    "aside": "sidebar related widget x y z",
    "section": "comments related newsletter discussion",
    "ul": "menu breadcrumb social pager comments",
    "form": "search subscribe login x y z",
    "nav": "main primary x",
    "header": "site masthead x",
    "footer": "site bottom x",
}
CONTENT = ["article", "content", "entry", "post", "story", "text", "body", "main"]
#: Asides that are part of the text.
QUOTES = ["pullquote", "pull-quote", "blockquote", "quote", "callout", "footnote", "footnotes", "definition", "example"]
WORDS = "the of and to in a is that for it was on as with be by at this from are or an have not which one".split()
WRAPPERS = [
    ("<article>", "</article>"),
    ("<main><article class='{c}'>", "</article></main>"),
    ("<main>", "</main>"),
    ("<div id='{c}'>", "</div>"),
    ("<div class='page-{c}'><div class='{c}'>", "</div></div>"),
    ("<section class='{c}-{c2}'>", "</section>"),
    ("<div>", "</div>"),
    ("", ""),
]


def labelled_pages(copies: int = 80, seed: int = 11) -> list[str]:
    r, cards, quotes, asides = random.Random(seed), random.Random(seed + 1), random.Random(seed + 2), random.Random(seed + 3)
    say = lambda lo, hi: " ".join(r.choices(WORDS, k=r.randint(lo, hi))).capitalize() + "."
    kinds = [(tag, word) for tag, words in BOILERPLATE.items() for word in words.split()]
    pages = []

    # words that are no hints (x, y, z) leave the weight to the element itself
    def off(tag: str, word: str) -> str:
        links = "".join(f"<li><a href='#'>{say(1, 2)}</a></li>" for _ in range(r.randint(2, 6)))
        inner = r.choice([f"<ul>{links}</ul>", f"<p>{say(4, 25)}</p>", f"<p>{say(4, 12)}</p><p><a href='#'>{say(1, 4)}</a></p>", say(3, 15), f"<label>{say(1, 3)}</label><input><button>{say(1, 1)}</button>"])
        if word.startswith("comment"):
            shape = r.choice(["<article class='comment'><p>{}</p></article>", "<p>{}</p>", "<div class='reply'>{}</div>"])
            inner = "".join(shape.format(say(5, 40)) for _ in range(r.randint(1, 4)))
        elif tag in ("div", "aside", "section") and cards.random() < 0.15:
            inner = "".join(f"<article{cards.choice(['', ' class=card'])}>{inner}</article>" for _ in range(cards.randint(1, 3)))
        if tag == "header":
            inner = r.choice(["<h1>{}</h1>", "<h1><a href='/'>{}</a></h1>", "<h1>{}</h1><p>x</p>"]).format(say(1, 5))
        return f"<{tag} {r.choice(['class', 'class', 'id'])}='{r.choice(['', 'site-', 'main-', 'x_'])}{word}'>{inner}</{tag}>"

    def block() -> str:
        body = r.choice(["<p>{}</p>"] * 6 + ["<p>{}<br><p>", "<p><b>{}</b></p>", "<ul><li>{}</li></ul>", "<blockquote>{}</blockquote>", "<table><tr><td>{}</td></tr></table>", "<h2>{}</h2>", "<p><a href='#'>{}</a></p>", "<pre>{}</pre>", "<div>{}</div>"])
        return "<x-main>" + body.format(say(2, 60)) + "</x-main>"

    for n in range(copies * len(WRAPPERS)):
        before, after = WRAPPERS[n % len(WRAPPERS)]
        c, c2 = r.choice(CONTENT), r.choice(CONTENT)
        pick = lambda among=kinds: off(*r.choice(among))
        title = f"<x-main><h1>{say(3, 10)}</h1></x-main>"
        title = r.choice([title, title, f"<header class='entry-header'>{title}</header>" if before else title])
        inside = [title, *(block() for _ in range(r.randint(1, 12)))]
        if before:
            for _ in range(r.randint(0, 2)):
                inside.insert(r.randint(1, len(inside)), pick([k for k in kinds if k[0] != "header"]))
            if asides.random() < 0.4:  # without a class, it stands apart by itself
                inside.insert(asides.randint(1, len(inside)), asides.choice(["<aside><p>{}</p></aside>", "<aside>{}</aside>", "<aside><h3>x</h3><ul><li>{}</li></ul></aside>"]).format(" ".join(asides.choices(WORDS, k=asides.randint(3, 30)))))
            if quotes.random() < 0.25:
                inside.insert(quotes.randint(1, len(inside)), f"<aside class='{quotes.choice(QUOTES)}'>{block()}</aside>")
        around = lambda k: "".join(pick() for _ in range(r.randint(1, k)))
        site = r.choice(["", "", f"<header><h1>{say(1, 3)}</h1></header>"]) if before else ""
        nav = "<nav><ul>" + "".join(f"<li><a href='#'>{say(1, 2)}</a></li>" for _ in range(6)) + "</ul></nav>"
        foot = f"<footer>{say(3, 20)}</footer>"
        pages.append(f"<!DOCTYPE html><html><head><title>{say(3, 9)}</title></head><body>{site}{nav}{around(3)}{before.format(c=c, c2=c2)}{''.join(inside)}{after}{around(4)}{foot}</body></html>")
    return pages
