"""Pages written by hand in layouts of common kinds, with their main blocks: how many of them the labeller finds."""

import numpy as np

from rastrel.llm import html_extract

PAGES = [
    ("""<html><head><title>Harbour news</title></head><body><header class="site-header"><a href="/">Harbour News</a><nav><a href="/w">World</a> <a href="/s">Sport</a></nav></header>
<main><article><h1>Bridge opens after nine years of work</h1><p class="byline">By our correspondent, Tuesday</p><figure><img src="b.jpg"><figcaption>The bridge on its first morning.</figcaption></figure>
<p>The new bridge over the harbour opened on Tuesday, nine years after the first stone was laid.</p><p>Thousands walked across it before noon, and the ferry company said it would keep one boat running.</p>
<aside class="related"><h3>Read more</h3><ul><li><a href="/1">Ferry prices rise</a></li><li><a href="/2">A short history of bridges</a></li></ul></aside>
<p>The mayor called it "a promise kept", although the cost had doubled since the plans were drawn.</p></article></main>
<footer><p>© Harbour News. All rights reserved.</p><a href="/t">Terms</a></footer></body></html>""",
     ["Bridge opens after nine years of work", "By our correspondent, Tuesday", "The bridge on its first morning.", "The new bridge over the harbour opened on Tuesday, nine years after the first stone was laid.",
      "Thousands walked across it before noon, and the ferry company said it would keep one boat running.", 'The mayor called it "a promise kept", although the cost had doubled since the plans were drawn.']),
    ("""<body><div id="top"><div class="menu"><ul><li><a href=/>Start</a><li><a href=/about>About me</a></ul></div></div><div id="content"><div class="post"><h2>On sharpening knives</h2>
<div class="entry"><p>I used to send my knives away, which took a week and cost more than the knives did.<p>Then a neighbour lent me a stone, and I have not looked back since.<blockquote>A dull knife is the dangerous one.</blockquote><p>Start with the coarse side, keep the angle low, and count your strokes.</div></div>
<div id="comments"><h3>2 comments</h3><div class="comment"><p>Great advice, thank you for writing it down!</p></div><div class="comment"><p>I disagree about the angle, mine is higher.</p></div><form><textarea>Your comment</textarea><button>Send</button></form></div></div>
<div id="sidebar"><h3>Archive</h3><ul><li><a href=/5>May</a><li><a href=/6>June</a></ul><div class="ad">Cheap stones, today only!</div></div><div id="footer">Powered by a small engine</div></body>""",
     ["On sharpening knives", "I used to send my knives away, which took a week and cost more than the knives did.", "Then a neighbour lent me a stone, and I have not looked back since.", "A dull knife is the dangerous one.",
      "Start with the coarse side, keep the angle low, and count your strokes."]),
    ("""<!doctype html><html><body><div class="cookie-banner" role="dialog"><p>We use cookies to make this site better. <button>Accept</button></p></div><nav class="navbar"><ul><li><a href="#">Docs</a></li><li><a href="#">Blog</a></li></ul></nav>
<main class="content"><h1>Installing the tool</h1><p>Download the archive for your system and unpack it somewhere on your path.</p><pre>tar xf tool.tar.gz
./tool --version</pre><h2>Options</h2><table><tr><th>Name</th><th>Meaning</th></tr><tr><td>--fast</td><td>Skips the slow checks, at your own risk.</td></tr></table><ol><li>Read the notes of the release first.</li><li>Back up the old folder.</li></ol></main>
<footer class="footer"><div>Contact</div><div>Imprint</div></footer></body></html>""",
     ["Installing the tool", "Download the archive for your system and unpack it somewhere on your path.", "tar xf tool.tar.gz ./tool --version", "Options", "Name", "Meaning", "--fast", "Skips the slow checks, at your own risk.",
      "Read the notes of the release first.", "Back up the old folder."]),
    ("""<body><header><div class="masthead"><a href="/">The free lexicon</a></div><form class="search"><input name=q><button>Find</button></form></header><div class="breadcrumbs"><a href="/">Start</a> &gt; <a href="/b">Birds</a></div>
<article class="entry"><h1>Heron</h1><p>Herons are long-legged birds that live near fresh water and along coasts.</p><h2>Diet</h2><p>They eat fish, frogs and, where they can get them, small mammals &amp; insects.</p><p>Hunting herons stand still for minutes; the speed <math><mi>v</mi></math> of the strike is high.</p></article>
<aside class="sidebar"><p>Did you know? The lexicon needs volunteers.</p></aside><div class="newsletter"><p>Get one article a day by mail.</p></div><footer><p>Text may be used freely under its licence.</p></footer></body>""",
     ["Heron", "Herons are long-legged birds that live near fresh water and along coasts.", "Diet", "They eat fish, frogs and, where they can get them, small mammals & insects.",
      "Hunting herons stand still for minutes; the speed v of the strike is high."]),
    ("""<body><nav><a href=/>Recipes</a> | <a href=/soups>Soups</a></nav><div class="article-body"><h1>Leek soup</h1><p>A soup for cold evenings, ready in half an hour.</p><ul><li>3 leeks, washed well</li><li>1 onion</li><li>1 litre of stock</li></ul>
<div class="advert">Order pans from our shop and save.</div><p>Fry the onion slowly, add the leeks, and let them soften without taking colour.</p><p>Pour in the stock and simmer for twenty minutes; season at the end.</p></div>
<section class="comments"><div class="comment-body"><p>Made it twice, the children loved it.</p></div></section><div class="footer">About | Contact | Privacy</div></body>""",
     ["Leek soup", "A soup for cold evenings, ready in half an hour.", "3 leeks, washed well", "1 onion", "1 litre of stock", "Fry the onion slowly, add the leeks, and let them soften without taking colour.",
      "Pour in the stock and simmer for twenty minutes; season at the end."]),
    ("""<html><body><table><tr><td colspan=2><a href=/>Village club</a></td></tr><tr><td class="menu"><a href=/news>News</a><br><a href=/team>Team</a></td><td class="content"><h3>Annual meeting</h3><p>The meeting takes place in the hall on the second Friday of March.</p>
<p>All members may vote, and guests are welcome to listen.</p></td></tr></table><div id="footer">Last changed in February</div></body></html>""",
     ["Annual meeting", "The meeting takes place in the hall on the second Friday of March.", "All members may vote, and guests are welcome to listen."]),
]


def test_pages_by_hand():
    lessons = [(html_extract.leaves(p), y) for p, y in html_extract.practice_pages(html_extract.PRACTICE)]
    model = html_extract.BiLstm(html_extract.PATH_DIMS + html_extract.WORD_DIMS + html_extract.SHAPE_DIMS).fit([(html_extract.vectors(b), np.array(y, dtype=np.float32)) for b, y in lessons])
    right = found = wanted = 0
    for page, main in PAGES:
        blocks = html_extract.leaves(page)
        assert set(main) <= {b.text for b in blocks}
        got = [b.text for b, s in zip(blocks, html_extract.label([blocks], model)[0], strict=True) if s >= 0.5]
        right, found, wanted = right + len(set(got) & set(main)), found + len(got), wanted + len(main)
    assert right >= 0.9 * wanted and right >= 0.9 * found
