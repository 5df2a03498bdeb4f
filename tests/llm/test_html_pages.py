"""HTML extraction on pages written by hand: layouts and names that the training pages are not made from."""

from cinderplan.llm import html_extract

#: (page, the blocks of its main text)
PAGES = [
    (
        """<!doctype html><html><head><title>Bread</title></head><body><div id="hd"><a href="/">Home</a> <a href="/b">Baking</a> <a href="/c">Contact</a></div>
<div class="entry"><h1>How we bake our bread</h1><p>Flour, water and salt are all that a good loaf needs.</p><p>The dough rests over night, and in the morning it is shaped, scored and baked on hot stone.</p>
<p>We sell it until noon, or until there is none left.</p></div><div id="ft"><p>&copy; 2019 The Corner Bakery. All rights reserved.</p></div></body></html>""",
        ["How we bake our bread", "Flour, water and salt are all that a good loaf needs.", "The dough rests over night, and in the morning it is shaped, scored and baked on hot stone.", "We sell it until noon, or until there is none left."],
    ),
    (
        """<html><body><header><nav><ul><li><a href="/">Start</a></li><li><a href="/news">News</a></li><li><a href="/sport">Sport</a></li></ul></nav></header>
<main><article><h1>River rises above its banks</h1><p class="byline">By Anna Berg, staff writer, on Monday morning in the old town hall.</p><p>After three days of rain the river has reached the lower streets of the town.</p>
<p>Firemen carried sandbags to the bridge, &quot;as we have done every spring&quot;, their captain said.</p></article></main>
<aside><h3>Most read</h3><ul><li><a href="/1">Bridge closed</a></li><li><a href="/2">School opens late</a></li></ul></aside><footer><p>Imprint | Privacy</p></footer></body></html>""",
        ["River rises above its banks", "By Anna Berg, staff writer, on Monday morning in the old town hall.", "After three days of rain the river has reached the lower streets of the town.", 'Firemen carried sandbags to the bridge, "as we have done every spring", their captain said.'],
    ),
    (
        """<body><table width="100%"><tr><td class="leftnav"><a href="a.html">Alpha</a><br><a href="b.html">Beta</a><br><a href="c.html">Gamma</a></td><td class="content"><h2>Notes on old clocks</h2>
<p>The clock in the tower was built by two brothers who never agreed on the time.</p><p>One of them set it early, the other late; visitors learnt to look at both faces and to take the middle.</p></td></tr></table></body>""",
        ["Notes on old clocks", "The clock in the tower was built by two brothers who never agreed on the time.", "One of them set it early, the other late; visitors learnt to look at both faces and to take the middle."],
    ),
    (
        """<html><body><div class="cookie-consent"><p>We use cookies to make this site better. By staying here you agree to it.</p><button>Accept</button></div>
<article class="post"><h1>Growing beans on a balcony</h1><p>Beans climb anything: a stick, a string, a neighbour's railing.</p><h2>Soil</h2><p>Use deep pots, and let the soil dry a little before you water again.</p><h2>Harvest</h2><p>Pick them young and often, and they will go on until autumn.</p></article>
<section id="comments"><h3>2 comments</h3><div class="comment"><b>Paul</b><p>Mine were eaten by snails last year, sadly.</p></div><div class="comment"><b>Ines</b><p>Try copper tape around the pots, it works.</p></div></section></body></html>""",
        ["Growing beans on a balcony", "Beans climb anything: a stick, a string, a neighbour's railing.", "Soil", "Use deep pots, and let the soil dry a little before you water again.", "Harvest", "Pick them young and often, and they will go on until autumn."],
    ),
    (
        """<html><body><main><h1>Tomato soup</h1><p>This soup takes half an hour and tastes of summer, even in March.</p><ul><li>One kilo of ripe tomatoes, cut in halves</li><li>Two onions and a spoon of butter</li><li>Salt, pepper, a little sugar</li></ul>
<ol><li>Melt the butter and fry the onions slowly.</li><li>Add the tomatoes and let them simmer for twenty minutes.</li></ol></main><footer>&copy; Kitchen Notes</footer></body></html>""",
        ["Tomato soup", "This soup takes half an hour and tastes of summer, even in March.", "One kilo of ripe tomatoes, cut in halves", "Two onions and a spoon of butter", "Salt, pepper, a little sugar", "Melt the butter and fry the onions slowly.", "Add the tomatoes and let them simmer for twenty minutes."],
    ),
    (
        """<html><body><ul class="breadcrumb"><li><a href="/">Home</a></li><li><a href="/docs">Docs</a></li></ul><div class="document"><h1>Installing the tool</h1><p>Unpack the archive into a folder of your own and add that folder to the path.</p><pre>tar xf tool.tar
export PATH=$PATH:$PWD/tool</pre><p>Then run it once without arguments: it prints its version &amp; ends.</p></div>
<div class="related"><h4>See also</h4><a href="/x">Removing the tool</a> <a href="/y">Upgrading</a></div></body></html>""",
        ["Installing the tool", "Unpack the archive into a folder of your own and add that folder to the path.", "tar xf tool.tar export PATH=$PATH:$PWD/tool", "Then run it once without arguments: it prints its version & ends."],
    ),
    (
        """<html><body><div class="masthead">The Valley Gazette</div><div class="story"><h1>Old mill to become a library</h1><p>The council voted on Tuesday to turn the empty mill into a library.<p>Work is to begin in autumn, and the wheel will stay.<p>"It has turned for grain, now it may turn for pages," the mayor said.</div>
<div class="sponsored"><p>Sponsored: the finest carpets of the valley, now at half the price!</p></div><div class="colophon"><p>Printed and published in the valley since 1902.</p></div></body></html>""",
        ["Old mill to become a library", "The council voted on Tuesday to turn the empty mill into a library.", "Work is to begin in autumn, and the wheel will stay.", '"It has turned for grain, now it may turn for pages," the mayor said.'],
    ),
    (
        """<html><body><nav class="x1"><a href="/">A</a><a href="/2">B</a><a href="/3">C</a></nav><div class="x2"><div class="x3"><h1>Walking the coast path</h1><p>The path begins behind the harbour and climbs at once to the cliffs.</p><p>From the top you see three islands, and on clear days a fourth.</p><p>Take water with you, as there is none on the way, and a coat even in summer.</p></div></div><footer class="x4">Copyright 2020 Example Inc.</footer></body></html>""",
        ["Walking the coast path", "The path begins behind the harbour and climbs at once to the cliffs.", "From the top you see three islands, and on clear days a fourth.", "Take water with you, as there is none on the way, and a coat even in summer."],
    ),
    (
        """<html><body><article><header><h1>What is a leap second?</h1></header><p>The earth turns a little unevenly, so clocks and the sky drift apart.</p><blockquote>Time is what keeps everything from happening at once.</blockquote><p>From 1972 on a second was put in now and then to bring them together.</p><div class="share"><a href="#">Share</a> <a href="#">Tweet</a> <a href="#">Mail</a></div></article><div class="newsletter"><form><label>Your address</label><input name="m"><button>Subscribe</button></form></div></body></html>""",
        ["What is a leap second?", "The earth turns a little unevenly, so clocks and the sky drift apart.", "Time is what keeps everything from happening at once.", "From 1972 on a second was put in now and then to bring them together."],
    ),
    (
        """<html><body><div role="navigation"><a href="/m">Museum</a> <a href="/v">Visit</a> <a href="/s">Shop</a></div><div role="main"><h2>The room of maps</h2><p>Forty maps hang here, the oldest drawn on calfskin by a monk who had never left his island.</p><figure><img src="m.png"><figcaption>The calfskin map, about 1250.</figcaption></figure><p>Its coasts are wrong, but its winds are right.</p></div><div role="contentinfo"><p>Open daily from ten to five. Closed on Mondays.</p></div></body></html>""",
        ["The room of maps", "Forty maps hang here, the oldest drawn on calfskin by a monk who had never left his island.", "The calfskin map, about 1250.", "Its coasts are wrong, but its winds are right."],
    ),
    (
        """<HTML><BODY><CENTER><A HREF="index.html">Index</A> | <A HREF="links.html">Links</A> | <A HREF="guest.html">Guestbook</A></CENTER><HR><H1>My stamp collection</H1><P>I began with one stamp from Peru that my aunt had steamed off a letter.<P>Today there are more than four thousand, in eleven albums.<P>If you have doubles, write to me and we can trade.<HR><CENTER><A HREF="index.html">Back</A></CENTER></BODY></HTML>""",
        ["My stamp collection", "I began with one stamp from Peru that my aunt had steamed off a letter.", "Today there are more than four thousand, in eleven albums.", "If you have doubles, write to me and we can trade."],
    ),
    (
        """<html><body><div id="top-bar"><span>Call us: 555 0100</span></div><div id="menu"><ul><li><a href="/">Home</a><li><a href="/w">Work</a><li><a href="/p">People</a></ul></div><div id="page"><section><h1>Our first year</h1><p>We started in a garage with two desks and a borrowed lamp.</p><p>By winter there were five of us, and the lamp had been given back.</p></section></div><div id="bottom"><ul><li><a href="/t">Terms</a><li><a href="/d">Data protection</a></ul></div></body></html>""",
        ["Our first year", "We started in a garage with two desks and a borrowed lamp.", "By winter there were five of us, and the lamp had been given back."],
    ),
    (
        """<html><body><article><h1>Prices of coal and bread, 1890 to 1910</h1><p>The table gives yearly means in pence, as the guild wrote them down.</p><table><tr><th>Year</th><th>Coal</th><th>Bread</th></tr><tr><td>1890</td><td>11</td><td>4</td></tr><tr><td>1910</td><td>17</td><td>6</td></tr></table><p>Both rose by half, wages by a third.</p></article><aside class="ads"><a href="/buy">Buy coal now</a></aside></body></html>""",
        ["Prices of coal and bread, 1890 to 1910", "The table gives yearly means in pence, as the guild wrote them down.", "Year", "Coal", "Bread", "1890", "11", "4", "1910", "17", "6", "Both rose by half, wages by a third."],
    ),
    (
        """<html><body><div class="modal"><p>Sign up now and get the first month free of charge.</p><a href="/n">No, thanks</a></div><main><h1>Why cats purr</h1><p>Cats purr when they are content, but also when they are hurt or afraid.</p><p>The sound may help their bones to heal; nobody knows for certain.</p></main><section class="recommended"><h2>You may also like</h2><div><h3><a href="/dogs">Why dogs bark</a></h3><p>A short history of barking.</p></div><div><h3><a href="/owls">Why owls hoot</a></h3><p>And who answers them.</p></div></section></body></html>""",
        ["Why cats purr", "Cats purr when they are content, but also when they are hurt or afraid.", "The sound may help their bones to heal; nobody knows for certain."],
    ),
    (
        """<html><body><p>There is nothing on this page but two paragraphs of text, without any frame at all around them.</p><p>The second of them is a little shorter than the first.</p></body></html>""",
        ["There is nothing on this page but two paragraphs of text, without any frame at all around them.", "The second of them is a little shorter than the first."],
    ),
    (
        """<html><body><header class="site"><h1>Garden Weekly</h1><p>All that grows, every week</p></header><div class="text"><h2>Pruning apple trees</h2><div>Cut in late winter, when the tree sleeps and the frost is over.</div><div>Take out what is dead, what crosses, and what grows straight up; leave the rest in peace.</div><div>A clean cut heals, a torn one rots.</div></div><footer class="site"><a href="/i">Imprint</a></footer></body></html>""",
        ["Pruning apple trees", "Cut in late winter, when the tree sleeps and the frost is over.", "Take out what is dead, what crosses, and what grows straight up; leave the rest in peace.", "A clean cut heals, a torn one rots."],
    ),
    (
        """<html><body><nav><a href="/de">Deutsch</a><a href="/fr">Fran&ccedil;ais</a></nav><article lang="fr"><h1>Le march&eacute; du samedi</h1><p>Chaque samedi, les paysans viennent avec leurs l&eacute;gumes et leurs fromages.</p><p>&Agrave; midi tout est vendu, et la place est vide jusqu&#8217;&agrave; la semaine suivante.</p></article><div class="pager"><a href="?p=1">1</a> <a href="?p=2">2</a> <a href="?p=3">3</a></div></body></html>""",
        ["Le marché du samedi", "Chaque samedi, les paysans viennent avec leurs légumes et leurs fromages.", "À midi tout est vendu, et la place est vide jusqu’à la semaine suivante."],
    ),
    (
        """<html><body><main><article><h1>Release 4.2</h1><p>This release mends three faults that <a href="/u">users</a> had told us of, and is faster on large files.</p><h3>Changes</h3><ul><li>Reads archives larger than four gigabytes.</li><li>No longer asks twice for the same password.</li></ul><p>Thanks to <a href="/t1">Mara</a>, <a href="/t2">Oleg</a> and <a href="/t3">Wen</a> for their reports.</p></article></main><footer><ul><li><a href="/a">About</a></li><li><a href="/s">Source</a></li></ul></footer></body></html>""",
        ["Release 4.2", "This release mends three faults that users had told us of, and is faster on large files.", "Changes", "Reads archives larger than four gigabytes.", "No longer asks twice for the same password.", "Thanks to Mara, Oleg and Wen for their reports."],
    ),
    (
        """<html><body><div class="alert"><p>This site will be down for an hour on Sunday night.</p></div><div class="post-body"><h1>Letters from the lighthouse</h1><p>The keeper wrote every day, though the boat came only once a month.</p><div class="ad-slot"><p>Your advertisement could be here.</p></div><p>In the end there were nine hundred letters, tied with fishing line.</p></div><ol class="commentlist"><li><p>My grandfather knew him well, what a story.</p></li><li><p>Where can one read them all?</p></li></ol></body></html>""",
        ["Letters from the lighthouse", "The keeper wrote every day, though the boat came only once a month.", "In the end there were nine hundred letters, tied with fishing line."],
    ),
    (
        """<html><body><form action="/s"><input name="q"><button>Search</button></form><section class="article-body"><h1>A short word on long trains</h1><p>Goods trains in the north can be three kilometres long.</p><p>The driver at the front is in the next village while the last car still leaves the station.</p></section><div class="social"><a href="#f">F</a> <a href="#t">T</a></div><div class="sidebar-right"><h4>Archive</h4><ul><li><a href="/05">May</a></li><li><a href="/06">June</a></li></ul></div><script>track("page");</script></body></html>""",
        ["A short word on long trains", "Goods trains in the north can be three kilometres long.", "The driver at the front is in the next village while the last car still leaves the station."],
    ),
    (
        """<html><body><div class="c-a1"><a href="/">Start</a><a href="/k">Katalog</a><a href="/h">Hilfe</a></div><div class="c-b2"><h1>Der alte Garten</h1><p>Hinter der Mauer liegt ein Garten, den seit Jahren niemand betreten hat.</p><p>Im Herbst fallen dort die Birnen ins Gras, und die Wespen feiern.</p></div><div class="c-c3"><a href="/agb">AGB</a> <a href="/ds">Datenschutz</a> <a href="/im">Impressum</a></div></body></html>""",
        ["Der alte Garten", "Hinter der Mauer liegt ein Garten, den seit Jahren niemand betreten hat.", "Im Herbst fallen dort die Birnen ins Gras, und die Wespen feiern."],
    ),
    (
        """<html><body><main><section><h1>Opening hours</h1><p>The swimming pool is open from six in the morning to nine at night.</p></section><section class="notice"><p>Please note that the sauna is closed for repairs.</p></section></main><div class="wp-widget-area"><h2>Tags</h2><a href="/t/a">water</a> <a href="/t/b">sport</a></div></body></html>""",
        ["Opening hours", "The swimming pool is open from six in the morning to nine at night."],
    ),
]


def test_pages_written_by_hand():
    assert len(PAGES) >= 20
    got = [x.split("\n\n") if x else [] for x in html_extract.extract_all([html for html, _ in PAGES], html_extract.trained())]
    found, want = sum(map(len, got)), sum(len(w) for _, w in PAGES)
    both = sum(len(set(g) & set(w)) for g, (_, w) in zip(got, PAGES, strict=True))
    wrong = [(k, sorted(set(w) - set(g)), sorted(set(g) - set(w))) for k, (g, (_, w)) in enumerate(zip(got, PAGES, strict=True)) if g != w]
    assert both >= 0.95 * want and both >= 0.95 * found, wrong
    assert len(wrong) <= 4, wrong
