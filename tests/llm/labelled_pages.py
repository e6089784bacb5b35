"""Pages labelled by hand, with little or no markup to go by: (html, lines of the article, in order).

The decay of the smoothness edges was set on ``PAGES``; ``HELD_OUT`` was written afterwards and nothing was set on it.
"""

PAGES = [
    (
        """<html><body><div><div><a href=/>Home</a> | <a href=/n>News</a> | <a href=/s>Sport</a></div></div>
        <div><div>The ferry that links both shores of the lake will not run this winter, the operator said on Monday, as repairs to its engine take longer than planned.</div>
        <div>What the mayor says</div>
        <div>"We were told of this very late," the mayor said, and asked the county for a bus that calls at every village along the northern road.</div>
        <div>No answer so far</div>
        <div>The county has yet to reply. Last year the same repair took four weeks, and the bus ran twice a day, which many who live there thought was too little.</div></div>
        <div><div>(c) Lake Press</div><div><a href=/i>Imprint</a></div></div></body></html>""",
        ["The ferry that links", "What the mayor says", '"We were told of this', "No answer so far", "The county has yet to"],
    ),
    (
        """<table><tr><td><a href=a>Start</a><br><a href=b>Archive</a></td><td><p>Bread needs time more than anything else, so begin the evening before and let the dough rest in a cool place.</p>
        <p>Flour</p><p>A strong flour takes up more water. Rye makes the crumb dense and keeps it moist for days, so a third of it is enough.</p>
        <p>Salt</p><p>Two parts in a hundred, added late, as salt slows the yeast down and makes the dough tighter to work with.</p></td></tr></table>
        <p><a href=x>top</a></p>""",
        ["Bread needs time", "Flour", "A strong flour", "Salt", "Two parts in a hundred"],
    ),
    (
        """<body><div class="widget-content"><p>The museum opens its new wing in May, with two hundred drawings that were kept in a cellar for most of the last century, and nobody had counted them.</p>
        <p>Most of them are small.</p><p>The oldest shows a harbour with eleven ships; the paper is so thin that it can be lit only a few hours each week, says the curator, and it will travel nowhere.</p></div>
        <ul><li><a href=1>One</a></li><li><a href=2>Two</a></li></ul></body>""",
        ["The museum opens", "Most of them are small", "The oldest shows"],
    ),
    (
        """<div><div>Log in</div><div>Basket</div><div>Help</div></div><div><h2>Frost in the vineyards</h2><div>Three nights in April were enough: half of the buds are lost, growers in the valley estimate, and in the low places there is nothing left.</div>
        <div>By our own reporter</div><div>Fires were lit between the rows, and a helicopter was hired to press the warmer air down, but the wind was against them and it cost more than it saved.</div></div>
        <div><div>Share</div><div>Print</div><div>Send</div></div>""",
        ["Frost in the vineyards", "Three nights in April", "By our own reporter", "Fires were lit"],
    ),
    (
        """<article><p>The bridge was closed for two days <span class="ad">Buy our pills now</span> while engineers looked at the cables. <button>Subscribe</button></p>
        <p>It is safe, they found.</p></article><aside><p>Other stories that you may like, told at some length, so that they look like an article.</p></aside>""",
        ["The bridge was closed for two days while engineers looked at the cables.", "It is safe, they found."],
    ),
    (
        """<div><span>MENU</span></div><div><div>Snow fell on the pass in June, which the road service had not seen in forty years of keeping records, and two coaches had to turn back.</div>
        <div>12 cm</div><div>That is little for the height, but it lay on leaves and brought down a hundred trees, some of them onto the railway, where trains stood until the evening.</div>
        <div>In July?</div><div>It may happen again, the service says, because cold air keeps coming down from the north and the sea is warmer than it used to be.</div></div><div>All rights reserved</div>""",
        ["Snow fell", "12 cm", "That is little", "In July?", "It may happen again"],
    ),
]

HELD_OUT = [
    (
        """<body><table><tr><td><font><a href=1>Index</a> <a href=2>Next</a></font></td></tr></table><center><h3>On sharpening knives</h3></center>
        <div><div>A dull knife slips, and that is how most people cut themselves; a sharp one goes where it is led, and it takes little strength to lead it.</div>
        <div>The stone</div><div>Soak it for ten minutes. Draw the blade over it as if to take off a thin slice, heel to tip, and keep the angle the same throughout.</div>
        <div>How often?</div><div>Whoever cooks each day will want to do this once a month, and to use a steel in between, which straightens the edge but takes nothing off.</div></div>
        <hr><div><div><a href=m>mail me</a></div><div>Visitors: 1204</div></div></body>""",
        ["On sharpening knives", "A dull knife slips", "The stone", "Soak it", "How often?", "Whoever cooks"],
    ),
    (
        """<div id="top"><div>Tuesday</div><div>Sunny, 21 degrees</div></div><div><div>Harbour reopens</div><div>The harbour was opened to sailing boats again on Tuesday, ten days after a barge had sunk at its mouth with a load of gravel that divers had to bring up by hand.</div>
        <div>A long wait</div><div>Forty boats had been waiting outside, some of them with little food on board, and the coast guard had taken three crews ashore during the storm at the weekend.</div></div>
        <div><div><a href=1>More</a></div><div><a href=2>Weather</a></div></div>""",
        ["Harbour reopens", "The harbour was opened", "A long wait", "Forty boats"],
    ),
]
