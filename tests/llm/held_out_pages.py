"""Pages written by hand, in layouts of common kinds of sites, with their main text block by block. Nothing is learned from them."""

PAGES = {
    "news": (
        """<!doctype html><html><head><title>Ferry returns | Coast Daily</title><script>if (a < b) { document.write("<p>no</p>") }</script></head><body class="has-sidebar">
<header class="site-header"><a href="/">Coast Daily</a><nav class="main-nav"><ul><li><a href="/n">News</a></li><li><a href="/s">Sport</a></li><li><a href="/w">Weather</a></li></ul></nav></header>
<div class="cookie-banner">We use cookies to improve your visit. <button>Accept all</button></div>
<main><article><header><h1>Ferry to the islands returns after nine years</h1><p>By Ann Holt, 3 May</p></header>
<p>The first ferry since 2015 left the old harbour at six on Monday morning with forty passengers &amp; eleven cars on board.</p>
<aside class="related-box"><h3>Read also</h3><ul><li><a href="/1">Harbour dues to rise</a></li><li><a href="/2">A night on the pier</a></li></ul></aside>
<p>&ldquo;We never thought it would come back,&rdquo; said the harbour master, who has kept the timetable on his wall all the while.</p>
<div class="ad-slot">Advertisement: cheap flights to the sun</div>
<p>Crossings run twice a day. In winter, there will be one.</p></article></main>
<aside id="sidebar"><h3>Most read</h3><ol><li><a href="/a">Storm closes coast road</a></li><li><a href="/b">Council votes on parking</a></li></ol></aside>
<section id="comments"><h2>2 comments</h2><div class="comment"><p>Great news, I will take it every week.</p></div><div class="comment"><p>Far too dear if you ask me.</p></div></section>
<footer><p>&copy; Coast Daily. All rights reserved.</p><a href="/imprint">Imprint</a></footer></body></html>""",
        ["Ferry to the islands returns after nine years", "By Ann Holt, 3 May", "The first ferry since 2015 left the old harbour at six on Monday morning with forty passengers & eleven cars on board.",
         "“We never thought it would come back,” said the harbour master, who has kept the timetable on his wall all the while.", "Crossings run twice a day. In winter, there will be one."],
    ),
    "form around all": (
        """<html><body><form id="aspnetForm" method="post"><div class="topbar"><a href="/">Start</a> <a href="/login">Sign in</a></div><div id="ctl00_body"><h1>Water levels this spring</h1>
<p>The lake stood two metres below its mean for the whole of April, the lowest level since records began.</p><p>Boats over eight metres cannot use the northern basin until further notice.</p></div>
<div class="bottom-links"><a href="/c">Contact</a> <a href="/p">Privacy</a></div></form></body></html>""",
        ["Water levels this spring", "The lake stood two metres below its mean for the whole of April, the lowest level since records began.", "Boats over eight metres cannot use the northern basin until further notice."],
    ),
    "sources": (
        """<body><nav><a href="/">Home</a><a href="/all">All articles</a></nav><article><h1>How bees find their way</h1><p>Bees use the sun, polarized light and the landmarks around the hive to find their way home over several kilometres.</p>
<p>Young bees learn the surroundings on short flights before they begin to forage in earnest.</p><h2>Sources</h2><ul><li><a href="/1">Frisch, The dance language and orientation of bees</a></li>
<li><a href="/2">Menzel and others, Honey bees navigate by a map</a></li></ul></article><footer>Imprint and contact</footer></body>""",
        ["How bees find their way", "Bees use the sun, polarized light and the landmarks around the hive to find their way home over several kilometres.",
         "Young bees learn the surroundings on short flights before they begin to forage in earnest.", "Sources", "Frisch, The dance language and orientation of bees", "Menzel and others, Honey bees navigate by a map"],
    ),
    "sidebar in Spanish": (
        """<body><div class="cabecera"><a href="/">Inicio</a> <a href="/blog">Blog</a></div><div class="contenido"><h1>Pan de pueblo</h1><p>Este pan necesita un día entero de reposo, pero apenas hay que trabajar la masa y el resultado merece la espera.</p>
<p>Mezcla la harina con el agua y la sal, cubre el cuenco y déjalo hasta la mañana siguiente.</p></div><div class="barra-lateral"><h3>Lo más leído</h3><ul><li><a href="/1">Sopa de ajo</a></li><li><a href="/2">Tortilla</a></li></ul>
<p>Apúntate al boletín</p></div><div class="pie">Todos los derechos reservados</div></body>""",
        ["Pan de pueblo", "Este pan necesita un día entero de reposo, pero apenas hay que trabajar la masa y el resultado merece la espera.", "Mezcla la harina con el agua y la sal, cubre el cuenco y déjalo hasta la mañana siguiente."],
    ),
    "notice board in an article": (
        """<body><header>Village pages</header><article><h1>The hall</h1><p>The hall was built in 1904 by the people of the village and has a stage, a kitchen and a small library.</p>
<div class="notice-board"><p>On the board by the door you will find the dates of the choir, the chess club and the film evenings.</p></div><p>Keys are kept at number nine.</p></article><footer>Parish council</footer></body>""",
        ["The hall", "The hall was built in 1904 by the people of the village and has a stage, a kitchen and a small library.", "On the board by the door you will find the dates of the choir, the chess club and the film evenings.", "Keys are kept at number nine."],
    ),
    "manual": (
        """<html><body><div class="layout"><div class="nav-tree"><ul><li><a href="#a">Install</a></li><li><a href="#b">Configure</a></li><li><a href="#c">Upgrade</a></li><li><a href="#d">Remove</a></li></ul></div>
<div class="doc"><h1>Configure the server</h1><p>The server reads one file at its start. Every option has a default, so an empty file is a valid file.</p><pre>port = 8080
workers = 4</pre><p>Press <button>Save</button> to keep the change. Let <math>x</math> be the number of workers.</p>
<table><tr><th>Option</th><th>Default</th></tr><tr><td>port</td><td>8080</td></tr></table></div></div><div class="footer"><a href="/v1">Version 1</a> <a href="/v2">Version 2</a></div></body></html>""",
        ["Configure the server", "The server reads one file at its start. Every option has a default, so an empty file is a valid file.", "port = 8080 workers = 4", "Press Save to keep the change. Let x be the number of workers.", "Option", "Default", "port", "8080"],
    ),
    "weblog": (
        """<body><div id="page"><div id="masthead"><h1><a href="/">Notes from the shed</a></h1></div><div id="primary"><div class="post hentry"><h2 class="entry-title">A bench from two boards</h2><div class="entry-content">
<p>I had two boards of ash left over from the loft, each as long as the shed is wide, and nowhere to sit.</p><p>So here is a bench. It took an afternoon, four bolts and most of a bottle of oil.</p>
<ol><li>Cut the legs to the height of your knee.</li><li>Bore the holes before you sand.</li></ol></div><div class="sharing"><ul><li><a href="/t">Tweet</a></li><li><a href="/m">Mail</a></li></ul></div>
<div class="entry-tags">Tagged: <a href="/wood">wood</a> <a href="/shed">shed</a></div></div><div id="comments" class="comments-area"><ol class="commentlist"><li>Lovely bench! What oil did you use?</li><li>Linseed, thinned a little for the first coat.</li></ol>
<form><p>Leave a reply</p><textarea>Your text</textarea><input type="submit"></form></div></div><div id="secondary" class="widget-area"><h3>Archive</h3><ul><li><a href="/5">May</a></li><li><a href="/4">April</a></li></ul></div></div></body>""",
        ["A bench from two boards", "I had two boards of ash left over from the loft, each as long as the shed is wide, and nowhere to sit.", "So here is a bench. It took an afternoon, four bolts and most of a bottle of oil.",
         "Cut the legs to the height of your knee.", "Bore the holes before you sand."],
    ),
    "German shop": (
        """<html><body><div class="hinweis">Versandkostenfrei ab 50 Euro</div><nav role="navigation"><a href="/1">Herren</a> <a href="/2">Damen</a> <a href="/3">Kinder</a></nav><div class="x7-ab2"><h1>Wanderschuh Nebelhorn</h1>
<p>Ein leichter Schuh für lange Wege: Die Sohle hält auch auf nassem Fels, und das Leder wird mit den Jahren nur besser.</p><ul><li>Wasserdicht bis zum Schaft</li><li>Neu besohlbar</li></ul><p>Wir empfehlen, ihn eine Nummer größer zu kaufen.</p></div>
<div class="newsletter-box"><p>Jetzt anmelden und zehn Prozent sparen!</p></div><footer><ul><li><a href="/agb">AGB</a></li><li><a href="/i">Impressum</a></li></ul></footer></body></html>""",
        ["Wanderschuh Nebelhorn", "Ein leichter Schuh für lange Wege: Die Sohle hält auch auf nassem Fels, und das Leder wird mit den Jahren nur besser.", "Wasserdicht bis zum Schaft", "Neu besohlbar", "Wir empfehlen, ihn eine Nummer größer zu kaufen."],
    ),
    "old tables": (
        """<html><body bgcolor=white><center><table><tr><td><a href=a.html>Index</a></td><td><a href=b.html>Links</a></td></tr></table></center><hr><h2>The wreck of the Maria</h2>
<p>The Maria ran on to the reef on the night of the ninth of January with a cargo of slate and two barrels of wine.<p>Of the crew of seven, five reached the shore. <br>The others were never found.<hr><center><a href=a.html>Back to the index</a></center></body></html>""",
        ["The wreck of the Maria", "The Maria ran on to the reef on the night of the ninth of January with a cargo of slate and two barrels of wine.", "Of the crew of seven, five reached the shore. The others were never found."],
    ),
    "encyclopedia": (
        """<body><div id="siteSub">From the free encyclopedia</div><div id="mw-navigation"><ul><li><a href="/m">Main page</a></li><li><a href="/r">Random page</a></li></ul></div><main id="content"><h1>Whin Sill</h1>
<p>The <b>Whin Sill</b> is a layer of <a href="/d">dolerite</a> in the north of <a href="/e">England</a>, which forms <a href="/c">cliffs</a> and <a href="/w">waterfalls</a>.</p><h2>Formation</h2><p>Magma spread between beds of older rock and cooled slowly, about 295 million years ago.</p>
<table><tr><th>Rock</th><td>Dolerite</td></tr><tr><th>Age</th><td>Carboniferous</td></tr></table><h2>References</h2><ol><li><a href="/x">Robson, The geology of the north east</a>, 1980.</li></ol></main><footer id="footer"><ul><li>This page was last edited on 4 May.</li><li><a href="/p">Privacy policy</a></li></ul></footer></body>""",
        ["Whin Sill", "The Whin Sill is a layer of dolerite in the north of England, which forms cliffs and waterfalls.", "Formation", "Magma spread between beds of older rock and cooled slowly, about 295 million years ago.", "Rock", "Dolerite", "Age", "Carboniferous",
         "References", "Robson, The geology of the north east, 1980."],
    ),
}
