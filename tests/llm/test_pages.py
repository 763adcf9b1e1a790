"""Main text of pages of common layouts, written by hand: FIRST ones shaped the training pages, SECOND ones did not."""

# ruff: noqa: E501
import pytest
from kelpie.llm import html_text

P = "The committee met on Tuesday to discuss the proposal, and after a long debate it was adopted by a narrow margin."
Q = "Critics said the plan would cost too much. Supporters, on the other hand, pointed to the benefits for smaller towns."
R = "A final vote is expected next month, once the figures have been reviewed by the finance office."
FIRST, SECOND = {}, {}
FIRST["wordpress"] = (f"""<!doctype html><html><head><title>x</title></head><body class="post-template single"><div id="page" class="site"><header id="masthead" class="site-header"><div class="site-branding"><p class="site-title"><a href="/">My Blog</a></p></div><nav id="site-navigation" class="main-navigation"><ul id="primary-menu" class="menu"><li class="menu-item"><a href="/">Home</a></li><li class="menu-item"><a href="/about">About</a></li></ul></nav></header><div id="content" class="site-content"><div id="primary" class="content-area"><main id="main" class="site-main"><article id="post-12" class="post type-post hentry"><header class="entry-header"><h1 class="entry-title">A narrow vote</h1></header><div class="entry-content"><p>{P}</p><h2>Reactions</h2><p>{Q}</p><blockquote><p>{R}</p></blockquote><ul><li>First point of the plan</li><li>Second point of the plan</li></ul></div><footer class="entry-footer"><span class="cat-links">Posted in <a href="/n">News</a></span></footer></article><nav class="navigation post-navigation"><a href="/prev">Previous post</a></nav><div id="comments" class="comments-area"><h2 class="comments-title">2 thoughts</h2><ol class="comment-list"><li class="comment"><p>Great article, thank you very much for writing it.</p></li></ol><form class="comment-form"><label>Name</label><input></form></div></main></div><aside id="secondary" class="widget-area"><section class="widget"><h2 class="widget-title">Recent Posts</h2><ul><li><a href="/1">One</a></li></ul></section></aside></div><footer id="colophon" class="site-footer"><div class="site-info">Proudly powered by words</div></footer></div></body></html>""",
 ["A narrow vote",P,"Reactions",Q,R,"First point of the plan","Second point of the plan"])
FIRST["plain body"] = (f"<html><body><h1>Notes</h1><p>{P}</p><p>{Q}</p><p>{R}</p></body></html>",["Notes",P,Q,R])
FIRST["no paragraphs"] = (f"<html><body><div class=nav><a href=/>Home</a> | <a href=/x>More</a></div><div class=main>{P}<br><br>{Q}<br><br>{R}</div><div class=footer>Copyright 2020 us</div></body></html>",[f"{P} {Q} {R}"])
FIRST["docs"] = (f"""<html><body><div class="sidebar"><ul><li><a href="/a">Install</a></li><li><a href="/b">Usage</a></li><li><a href="/c">Api</a></li></ul></div><div role="main" class="document"><div class="body"><section id="usage"><h1>Usage</h1><p>{P}</p><pre>import x
x.run()</pre><p>{Q}</p><table><tr><th>Name</th><th>Meaning</th></tr><tr><td>a</td><td>first letter of all</td></tr></table></section></div></div><div class="footer">Built with care</div></body></html>""",
 ["Usage",P,"import x x.run()",Q,"Name","Meaning","a","first letter of all"])
FIRST["news"] = (f"""<html><body><div class="cookie-banner">We use cookies to improve your experience. <button>Accept</button></div><div class="top-bar"><a href="/">Daily</a><a href="/sport">Sport</a></div><div class="layout"><div class="col-8"><h1 class="headline">Town votes</h1><div class="byline">By Jane Doe</div><div class="share-buttons"><a href="#">Share</a></div><div class="story-body"><p>{P}</p><div class="ad-slot" id="ad1">Advertisement</div><p>{Q}</p><aside class="related"><h3>Related stories</h3><ul><li><a href=/1>Another vote fails</a></li></ul></aside><p>{R}</p></div></div><div class="col-4"><div class="most-read"><h3>Most read</h3><ol><li><a href=/2>Story two</a></li></ol></div></div></div><footer><p>All rights reserved.</p></footer></body></html>""",
 ["Town votes",P,Q,R])
FIRST["table layout"] = (f"""<html><body><table width=100%><tr><td colspan=2><a href=/>Home</a> <a href=/l>Links</a></td></tr><tr><td class=menu><a href=/1>One</a><br><a href=/2>Two</a></td><td><h2>Old page</h2><p>{P}<p>{Q}<p>{R}</td></tr><tr><td colspan=2>Copyright 1998</td></tr></table></body></html>""",["Old page",P,Q,R])
FIRST["anon divs"] = (f"""<html><body><div><div><a href=/>Start</a></div><div><ul><li><a href=/a>A</a></li><li><a href=/b>B</a></li></ul></div></div><div><div><h1>Heading here</h1><div>{P}</div><div>{Q}</div><div>{R}</div></div></div><div>Imprint <a href=/i>Contact</a></div></body></html>""",["Heading here",P,Q,R])
FIRST["forum comments"] = (f"""<html><body><main><article><h1>Post</h1><p>{P}</p><p>{Q}</p></article><section class="discussion"><h3>3 Comments</h3><div class="comment"><p>{R} I think that is quite a long comment, but it is one nevertheless, and goes on.</p></div><div class="comment"><p>{Q}</p></div></section></main></body></html>""",["Post",P,Q])
FIRST["german"] = ("<html lang=de><body><nav><a href=/>Start</a></nav><article><h1>Titel</h1><p>Der Ausschuss tagte am Dienstag, um über den Vorschlag zu beraten; nach langer Debatte wurde er knapp angenommen.</p><p>Kurz.</p></article><footer>Impressum</footer></body></html>",["Titel","Der Ausschuss tagte am Dienstag, um über den Vorschlag zu beraten; nach langer Debatte wurde er knapp angenommen.","Kurz."])
FIRST["short article"] = ("<html><body><header><a href=/>Site</a></header><article><h1>Hi</h1><p>Short.</p></article><footer>Footer text that is longer than the article, with many words in it to confuse.</footer></body></html>",["Hi","Short."])
FIRST["newsletter in article"] = (f"<html><body><article><h1>T</h1><p>{P}</p><form class=newsletter><p>Subscribe to our newsletter and never miss a story again.</p><input></form><p>{Q}</p><div class=author-bio>Jane writes about towns.</div></article></body></html>",["T",P,Q])
SECOND["recipe"] = (f"<html><body><div id=wrap><div id=top><a href=/>Cooking</a></div><div id=content><h1>Bread</h1><p>{P}</p><h3>Ingredients</h3><ul><li>Flour</li><li>Water</li><li>Salt</li></ul><h3>Method</h3><ol><li>Mix it all and let it rest.</li><li>Bake it.</li></ol></div><div id=bottom>Contact | Imprint</div></div></body></html>",["Bread",P,"Ingredients","Flour","Water","Salt","Method","Mix it all and let it rest.","Bake it."])
SECOND["wiki"] = (f"<html><body><div id='mw-navigation'><ul><li><a href=/m>Main page</a></li></ul></div><div id='content' class='mw-body' role='main'><h1 id='firstHeading'>Town</h1><div id='bodyContent'><p>{P} <a href='/w'>Committee</a> of <a href='/x'>the town</a>.</p><div id='toc' class='toc'><ul><li><a href='#h'>History</a></li></ul></div><h2>History</h2><p>{Q}</p></div></div><div id='footer' role='contentinfo'><ul><li>Text is available under a licence.</li></ul></div></body></html>",["Town",P+" Committee of the town.","History",Q])
SECOND["two column"] = (f"<html><body><div class=container><div class=row><div class='col-3 sidebar'><h4>Topics</h4><a href=/a>One</a><a href=/b>Two</a></div><div class='col-9'><h2>Heading</h2><p>{P}</p><p>{Q}</p></div></div></div><div class='popup modal'>Sign up now for free</div></body></html>",["Heading",P,Q])
SECOND["q and a"] = (f"<html><body><header><nav><a href=/>Q</a></nav></header><main><article class=post><h1>How does it work?</h1><dl><dt>First</dt><dd>{P}</dd><dt>Second</dt><dd>{Q}</dd></dl></article></main><footer>Footer</footer></body></html>",["How does it work?","First",P,"Second",Q])
SECOND["long links"] = (f"<html><body><nav><ul>{'<li><a href=/x>Some menu entry</a></li>'*30}</ul></nav><article><h1>T</h1><p>{P}</p></article><aside><p>{Q} <a href=/>more</a></p></aside></body></html>",["T",P])
SECOND["paywall"] = (f"<html><body><article><h1>T</h1><p>{P}</p><div class='paywall-notice'><p>Subscribe to read on. It costs little.</p></div><p>{Q}</p></article></body></html>",["T",P,Q])
SECOND["code blog"] = (f"<html><body><div class=blog><div class='post-header'><h1>On loops</h1><span class=date>2020-01-01</span></div><div class=post-content><p>{P}</p><pre><code>for x in y:\n  z()</code></pre><p>{Q}</p></div><div class=tags>Tags: <a href=/t>loops</a></div></div></body></html>",["On loops",P,"for x in y: z()",Q])
SECOND["figure"] = (f"<html><body><main><h1>Pic</h1><figure><img src=a.png><figcaption>A picture of the town hall</figcaption></figure><p>{P}</p></main><footer><p>{R}</p></footer></body></html>",["Pic","A picture of the town hall",P])


@pytest.mark.parametrize("name", [*FIRST, *SECOND])
def test_pages(name):
    html, blocks = (FIRST | SECOND)[name]
    (got,) = html_text.extract([html], html_text.trained())
    assert got.split("\n") == blocks
