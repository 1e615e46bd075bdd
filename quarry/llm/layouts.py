"""Labelled pages: layouts of our own, with data-label="main" where an element's text is content and data-label="none" where not.

They show the model what a table of pages may not hold: pages without <article>, sidebars, notices, forms, comments. Sentences
are drawn from a list in turn, so that words tell nothing.
"""

from __future__ import annotations

from itertools import count

SENTENCES = (
    "The ferry left the harbour an hour late, and nobody on the pier seemed to mind.",
    "Prices rose by three percent in spring, which was less than most growers had feared.",
    "She kept the old maps in a drawer under the stairs.",
    "A second survey, done two years later, gave almost the same result for both valleys.",
    "Bake the loaf until it sounds hollow, then let it rest on a rack for an hour.",
    "Why did the bridge hold when the others failed?",
    "The committee will meet again in June to look at the plans for the new library.",
    "Nothing in the report says who paid for the repairs, or when they were finished.",
    "Water boils at a lower temperature in the mountains, so beans take longer to cook.",
    "It was the fourth win in a row for a team that many had written off before the season.",
    "Short answer: no.",
    "In the north the harvest starts in August; in the south it can be over by then.",
)
LINKS = ("Home", "News", "Sport", "About us", "Contact", "Archive", "Weather", "Shop", "Jobs", "Culture", "Travel", "Opinion")


def _layouts() -> list[str]:
    at, link = count(), count()

    def say(n: int) -> str:
        return " ".join(SENTENCES[next(at) * 5 % len(SENTENCES)] for _ in range(n))

    def title() -> str:
        return " ".join(say(1).split()[:5]).rstrip(".,;")

    def p(*sizes: int) -> str:
        return "".join(f"<p>{say(n)}</p>" for n in sizes)

    def a() -> str:
        return f'<a href="/{next(link)}">{LINKS[next(link) % len(LINKS)]}</a>'

    def menu(n: int) -> str:
        return "<ul>" + "".join(f"<li>{a()}</li>" for _ in range(n)) + "</ul>"

    return [
        # a plain article page
        f'<html><body><header><a href="/">The Daily</a></header><nav>{menu(5)}</nav><article data-label="main"><h1>{title()}</h1>{p(3, 2, 1, 4)}</article><footer>&copy; 2021 The Daily. All rights reserved.</footer></body></html>',
        # containers named by class only, a sidebar
        f'<body><div class="topbar">{menu(4)}</div><div id="wrapper"><div class="post-content" data-label="main"><h2>{title()}</h2>{p(2, 3)}<blockquote>{say(2)}</blockquote>{p(1)}</div><div class="sidebar"><h3>Recent posts</h3>{menu(5)}<p>{say(1)}</p></div></div><div id="footer"><p>Copyright 2019. Imprint | Privacy</p></div></body>',
        # no names at all
        f'<body><div>{a()} | {a()} | {a()}</div><div><div data-label="main"><h1>{title()}</h1>{p(4, 3, 3, 2)}</div></div><div>{a()} {a()} &copy; someone</div></body>',
        # reader comments under the text
        f'<body><nav>{menu(3)}</nav><main data-label="main"><h1>{title()}</h1>{p(2, 2, 3)}<section class="comments" data-label="none"><h3>3 comments</h3><div class="comment"><b>Ann</b><p>{say(2)}</p></div><div class="comment"><b>Bo</b><p>{say(3)}</p></div></section></main></body>',
        f'<body><div class="article" data-label="main"><h1>{title()}</h1>{p(3, 3)}</div><div id="disqus_thread"><ul class="comment-list"><li><p>{say(2)}</p></li><li><p>{say(1)}</p><p>{say(2)}</p></li></ul><form><p>{say(1)}</p></form></div></body>',
        # a cookie notice and a banner before the text
        f'<body><div class="cookie-banner"><p>We use cookies. {say(1)}</p><a href="#">Accept</a></div><div class="ad">{say(1)}</div><article data-label="main"><h1>{title()}</h1><p>{say(1)}</p>{p(3, 1)}<div class="advert" data-label="none"><p>{say(2)}</p></div>{p(2)}</article><aside><h4>Read next</h4>{menu(3)}</aside></body>',
        # forms
        f'<body><form class="search"><label>Search the site</label></form><div class="content" data-label="main"><h1>{title()}</h1>{p(2, 2)}<form data-label="none"><p>Subscribe to our letter. {say(1)}</p><label>Your address</label></form>{p(1)}</div><div class="newsletter"><p>{say(1)}</p></div></body>',
        # lists and tables that are content
        f'<body><nav>{menu(6)}</nav><article data-label="main"><h1>{title()}</h1>{p(1)}<ul><li>{say(1)}</li><li>{say(1)}</li><li>Two eggs</li></ul><h2>{title()}</h2><ol><li>{say(2)}</li><li>{say(1)}</li></ol><table><tr><th>Year</th><th>Tons</th></tr><tr><td>2001</td><td>14</td></tr></table>{p(2)}</article><footer>{menu(4)}</footer></body>',
        # layout by tables
        f'<body><table><tr><td colspan="2">{a()} {a()} {a()}</td></tr><tr><td width="150">{a()}<br>{a()}<br>{a()}</td><td data-label="main"><h1>{title()}</h1>{p(3, 2, 2)}</td></tr><tr><td>&copy; 2003 webmaster</td></tr></table></body>',
        # text without paragraphs
        f'<body><div class="menu">{a()} {a()}</div><div class="entry" data-label="main">{say(4)}<br><br>{say(5)}<br>{say(3)}</div><div class="related">{a()} {a()} {a()}</div></body>',
        # a long page of short paragraphs
        f'<body><header><h2><a href="/">Notes</a></h2>{menu(3)}</header><article data-label="main"><h1>{title()}</h1><p>Yes.</p><p>The.</p>{p(1, 1, 1, 2, 1)}<p>No.</p>{p(1)}</article><footer><p>{say(1)}</p>Powered by patience</footer></body>',
        # a sidebar of prose and a text with links
        f'<body><div class="container"><div class="main-column" data-label="main"><h1>{title()}</h1><p>{say(1)} <a href="/x">{say(1)}</a> {say(1)}</p>{p(2, 3)}<figure><figcaption>{say(1)}</figcaption></figure></div><aside class="rail"><h3>About the author</h3><p>{say(3)}</p><h3>Popular</h3>{menu(4)}</aside></div></body>',
        # share bars and tags inside the text
        f'<body><article data-label="main"><header><h1>{title()}</h1></header><div class="share" data-label="none">{a()} {a()}</div>{p(3, 2)}<ul class="tags" data-label="none"><li>{a()}</li><li>{a()}</li></ul><nav class="pager" data-label="none">{a()} {a()}</nav></article><div role="complementary"><p>{say(2)}</p></div></body>',
        # a page without any text of its own
        f'<body><nav>{menu(8)}</nav><div class="teasers">{menu(6)}</div><footer>{menu(3)}&copy; 2020</footer></body>',
        # a notice in the text column, several sections
        f'<body><div class="alert">{say(1)}</div><section data-label="main"><h2>{title()}</h2>{p(2, 2)}</section><section data-label="main"><h2>{title()}</h2>{p(3)}</section><section class="signup"><h2>Stay in touch</h2><p>{say(1)}</p></section><div class="legal"><p>{say(2)}</p></div></body>',
    ]


LAYOUTS = _layouts()
