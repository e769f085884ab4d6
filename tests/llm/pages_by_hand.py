"""Pages written and labelled by hand: (name, html, texts of the article blocks). None comes from the generator."""

T = [
    "The harbour was rebuilt in 1923 after the great fire, and most of the brick warehouses that stand today date from that decade.",
    "Engineers first drained the northern basin, which took eleven months, and then drove oak piles into the clay.",
    "By the spring of 1925 the first cranes were working, and ships from Bergen and Riga unloaded timber again.",
    "Local historians still argue about who paid for the work; the town's books for those years are lost.",
    "Today the quay is a museum, a fish market and, on summer evenings, a place to sit and watch the light go.",
]
D = [
    "Der Wald hinter dem Dorf wurde im vorigen Jahrhundert zweimal gerodet und jedes Mal neu gepflanzt.",
    "Heute wachsen dort vor allem Buchen, und im Herbst kommen viele Leute aus der Stadt, um Pilze zu suchen.",
    "Der Förster sagt, dass die trockenen Sommer den Fichten mehr geschadet haben als der Sturm von 1990.",
]
F = [
    "Le marché couvert a été construit en 1871 par un architecte venu de Lyon, avec une charpente en fer.",
    "On y trouve encore aujourd'hui des fromagers, des poissonniers et une librairie qui n'ouvre que le samedi.",
    "La mairie veut le rénover, mais les commerçants craignent des travaux trop longs et des loyers plus chers.",
]
S = [
    "El tren de la sierra salía cada mañana a las seis y tardaba cuatro horas en llegar a la costa.",
    "Los viajeros llevaban pan, naranjas y gallinas, y en cada estación subía alguien con una guitarra.",
    "La línea cerró en 1984, aunque todavía se puede caminar por los túneles con una linterna.",
]


def p(texts):
    return "".join(f"<p>{t}</p>" for t in texts)


def bare(texts):
    return "".join(f"<p>{t}\n" for t in texts)


def links(*names):
    return "<ul>" + "".join(f'<li><a href="/{n}">{n}</a></li>' for n in names) + "</ul>"


PAGES = [
    ("div only", f'<html><head><title>x</title></head><body><div class="top"><a href="/">Home</a> <a href="/n">News</a> <a href="/s">Sport</a></div><div class="txt"><h1>The old harbour</h1>{p(T[:4])}</div><div class="low">Copyright 2021 Harbour Post</div></body></html>',
     ["The old harbour", *T[:4]]),
    ("comments as articles", f'<body><header><a href="/">Quay Weekly</a></header><article><h1>The old harbour</h1>{p(T)}</article><section id="reactions"><article><h3>Marta</h3><p>I grew up next to it, lovely piece!</p></article><article><h3>joe77</h3><p>The cranes came later, my uncle drove one.</p></article></section><footer>Imprint</footer></body>',
     ["The old harbour", *T]),
    ("omitted end tags", f'<!DOCTYPE html><title>Harbour</title><nav><ul><li><a href=/>Home</a><li><a href=/map>Map</a></ul></nav><main><h1>The old harbour</h1>{bare(T)}</main><footer><p>All rights reserved.</footer>',
     ["The old harbour", *T]),
    ("table layout", f'<html><body><table width=100%><tr><td colspan=2><a href="/">Home</a> | <a href="/a">Archive</a> | <a href="/c">Contact</a></td></tr><tr><td width=150><a href="1.html">Chapter 1</a><br><a href="2.html">Chapter 2</a><br><a href="3.html">Chapter 3</a></td><td><h2>Chapter 1</h2>{p(T[:4])}</td></tr><tr><td colspan=2>Last updated 2003. Webmaster</td></tr></table></body></html>',
     ["Chapter 1", *T[:4]]),
    ("no classes at all", f'<html><body><div><a href="/">Start</a> <a href="/b">Blog</a> <a href="/i">Impressum</a></div><div><h1>Der Wald</h1>{p(D)}</div><div><a href="/datenschutz">Datenschutz</a> <a href="/agb">AGB</a></div></body></html>',
     ["Der Wald", *D]),
    ("cookie bar and newsletter", f'<body><div id="cookie-bar"><p>We use cookies to give you the best experience.</p><button>Accept</button></div><div id="content"><h1>The old harbour</h1>{p(T[:3])}<div class="newsletter-signup"><p>Get our weekly letter in your inbox.</p><form><input type=email><button>Subscribe</button></form></div>{p(T[3:])}</div></body>',
     ["The old harbour", *T]),
    ("sidebar before text", f'<body><div id="wrap"><div id="sidebar"><h3>Popular</h3>{links("Ten best walks", "Where to eat", "Boats for hire")}<h3>Archive</h3>{links("May 2020", "June 2020")}</div><div id="main"><h2>The old harbour</h2><p class="meta">Posted by Anna on 3 May 2020</p>{p(T[:4])}</div></div></body>',
     ["The old harbour", *T[:4]]),
    ("french blog", f'<html lang=fr><body><div class="entete"><h1><a href="/">Carnets de marché</a></h1></div><div class="billet"><h2>Le marché couvert</h2>{p(F)}</div><div class="commentaires"><h3>3 commentaires</h3><div><b>Luc</b><p>Merci pour ce bel article !</p></div><div><b>Inès</b><p>La librairie ouvre aussi le dimanche.</p></div></div><div class="pied">Tous droits réservés</div></body></html>',
     ["Le marché couvert", *F]),
    ("spanish page", f'<body><nav><a href="/">Inicio</a><a href="/v">Viajes</a></nav><section><h1>El tren de la sierra</h1>{p(S)}</section><aside><h4>Te puede interesar</h4>{links("La costa en invierno", "Diez pueblos")}</aside><footer>Aviso legal · Contacto</footer></body>',
     ["El tren de la sierra", *S]),
    ("recipe", f'<body><div class="menu">{links("Soups", "Salads", "Cakes")}</div><div class="recipe"><h1>Pea soup</h1><p>A thick soup for cold days, which needs no more than one pot and an hour.</p><ul><li>500 g of dried peas, soaked overnight</li><li>Two carrots and an onion, chopped</li><li>A bay leaf, salt and pepper</li></ul><ol><li>Fry the onion and the carrots in a little butter until they are soft.</li><li>Add the peas, the bay leaf and a litre of water, and simmer for an hour.</li><li>Take out the leaf, season, and serve with dark bread.</li></ol></div><div class="foot">Privacy | Terms</div></body>',
     ["Pea soup", "A thick soup for cold days, which needs no more than one pot and an hour.", "500 g of dried peas, soaked overnight", "Two carrots and an onion, chopped", "A bay leaf, salt and pepper", "Fry the onion and the carrots in a little butter until they are soft.", "Add the peas, the bay leaf and a litre of water, and simmer for an hour.", "Take out the leaf, season, and serve with dark bread."]),
    ("adverts between paragraphs", f'<body><article><h1>The old harbour</h1><p>{T[0]}</p><div class="advertisement"><p>Advertisement</p><p>Cheap flights to Bergen from 29.</p></div><p>{T[1]}</p><div class="ad-slot"><a href="/x">Buy boots now</a></div>{p(T[2:])}</article></body>',
     ["The old harbour", *T]),
    ("quotes in tags", f"<body><nav><a href=/ title=it's>Home</a></nav><article><h1 title=\"the \"old\" one\">The old harbour</h1><p data-x='a>b'>{T[0]}</p><p title=o'clock>{T[1]}</p><p class=\"x>{T[2]}</p></article></body>",
     ["The old harbour", *T[:3]]),
    ("list of links only", f'<body><h3>Contents</h3>{links("One", "Two", "Three", "Four", "Five", "Six")}<div class="footer">Copyright 2011</div></body>', []),
    ("login page", '<body><div class="header"><a href="/">Portal</a></div><form class="login"><label>User name</label><input><label>Password</label><input type=password><button>Log in</button></form><p class="legal">Terms of use</p></body>', []),
    ("old page with br", f'<html><body bgcolor=white><center><a href="index.html">Index</a> - <a href="links.html">Links</a></center><h1>The old harbour</h1><p>{T[0]}<br>{T[1]}<p>{T[2]}<p>{T[3]}<hr><address>Mail the webmaster</address></body></html>',
     ["The old harbour", f"{T[0]} {T[1]}", T[2], T[3]]),
    ("main with share bar", f'<body><header><div class="logo">The Post</div><nav>{links("World", "Culture", "Money")}</nav></header><main><div class="share"><a href="#">Share</a> <a href="#">Tweet</a></div><h1>The old harbour</h1><p class="lead">{T[0]}</p>{p(T[1:])}<div class="tags"><a href="/t/h">harbour</a> <a href="/t/m">museum</a></div></main><footer><p>Copyright The Post. All rights reserved.</p></footer></body>',
     ["The old harbour", *T]),
    ("german news", f'<body><div id="kopf"><a href="/">Waldbote</a> <a href="/sport">Sport</a> <a href="/wetter">Wetter</a></div><div id="inhalt"><h1>Der Wald hinter dem Dorf</h1>{p(D)}</div><div id="kommentare"><h3>Kommentare</h3><p>Sehr schöner Text, danke.</p><p>Bei uns steht kaum noch eine Fichte.</p></div><div id="fuss">Impressum | Datenschutz</div></body>',
     ["Der Wald hinter dem Dorf", *D]),
    ("quote and figure", f'<body><article><h1>The old harbour</h1><p>{T[0]}</p><blockquote>We had nothing but clay and rain, and still we built it, said one of the workers.</blockquote><figure><img src=x><figcaption>The basin in 1924, before the cranes came.</figcaption></figure>{p(T[1:])}</article></body>',
     ["The old harbour", T[0], "We had nothing but clay and rain, and still we built it, said one of the workers.", "The basin in 1924, before the cranes came.", *T[1:]]),
    ("related stories behind", f'<body><div class="story"><h1>The old harbour</h1>{p(T)}</div><div class="related"><h3>More stories</h3><div><a href="/1">A night on the ferry</a></div><div><a href="/2">The last lighthouse keeper</a></div><div><a href="/3">How to smoke a herring</a></div></div></body>',
     ["The old harbour", *T]),
    ("deep wrappers", f'<body><div><div><div><div><div class="nav"><a href="/">Home</a> <a href="/x">Up</a></div><div><div><h1>The old harbour</h1><div>{p(T[:4])}</div></div></div></div></div></div></div></body>',
     ["The old harbour", *T[:4]]),
    ("unclosed object", f'<body><div class="menu"><a href="/">Home</a> <a href="/v">Videos</a></div><object data="film.swf"><article><h1>The old harbour</h1>{p(T[:4])}</article><div class="footer">Copyright</div></body>',
     ["The old harbour", *T[:4]]),
    ("svg and scripts", f'<body><nav><svg viewBox="0 0 1 1"><title>Menu</title><path d="M0 0"/></svg><a href="/">Home</a></nav><article><h1>The old harbour</h1><script>var p="<p>not text</p>";</script>{p(T[:3])}<style>p{{margin:0}}</style></article></body>',
     ["The old harbour", *T[:3]]),
    ("comments without class", f'<body><h1>The old harbour</h1>{p(T)}<h3>Comments (2)</h3><ul><li><b>Marta says:</b><p>Lovely piece, thank you.</p><a href="#">Reply</a></li><li><b>joe77 says:</b><p>My uncle drove a crane there.</p><a href="#">Reply</a></li></ul><p>Leave a comment</p></body>',
     ["The old harbour", *T]),
    ("short article", f'<body><nav>{links("Home", "News", "About")}</nav><article><h1>Ferry late</h1><p>The evening ferry to the island was an hour late on Monday because of fog.</p></article><footer>Contact us</footer></body>',
     ["Ferry late", "The evening ferry to the island was an hour late on Monday because of fog."]),
    ("sections inside", f'<body><header><h2>Harbour Museum</h2></header><article><h1>Guide</h1><section><h2>The basin</h2>{p(T[:2])}</section><section><h2>The quay</h2>{p(T[2:])}</section></article><footer>Opening hours: 9 to 17</footer></body>',
     ["Guide", "The basin", *T[:2], "The quay", *T[2:]]),
    ("documentation", f'<body><div class="toc"><ul><li><a href="#a">Install</a></li><li><a href="#b">Use</a></li><li><a href="#c">Limits</a></li></ul></div><div class="docs"><h1>Crane control</h1><p>The program drives up to four cranes over one serial line and writes a log of every move.</p><h2>Install</h2><p>Unpack the archive and start the setup, which asks for the port and the number of cranes.</p><pre>setup --port 3 --cranes 2</pre><h2>Limits</h2><p>It has not been tried with more than four cranes or with cables longer than thirty metres.</p></div></body>',
     ["Crane control", "The program drives up to four cranes over one serial line and writes a log of every move.", "Install", "Unpack the archive and start the setup, which asks for the port and the number of cranes.", "setup --port 3 --cranes 2", "Limits", "It has not been tried with more than four cranes or with cables longer than thirty metres."]),
    ("banner on top", f'<body><div class="promo-banner"><p>Summer sale: twenty percent off all prints until Sunday!</p></div><div class="site-nav"><a href="/">Home</a><a href="/p">Prints</a></div><div class="post"><h2>The old harbour</h2>{p(T[:4])}</div></body>',
     ["The old harbour", *T[:4]]),
    ("text in table cells", f'<body><nav>{links("Home", "Tides")}</nav><article><h1>Tides</h1><p>The table below gives the height of the water at the old quay, in metres above the lowest mark.</p><table><tr><th>Month</th><th>High</th></tr><tr><td>January</td><td>4.1</td></tr><tr><td>June</td><td>3.2</td></tr></table><p>{T[4]}</p></article><footer>Copyright</footer></body>',
     ["Tides", "The table below gives the height of the water at the old quay, in metres above the lowest mark.", "Month", "High", "January", "4.1", "June", "3.2", T[4]]),
    ("terms in a list", f'<body><div class="hd"><a href="/">Glossary</a></div><div class="bd"><h1>Words of the port</h1><p>Dockers had their own words, some of which came from Dutch and Danish sailors.</p><dl><dt>Bollard<dd>A thick post on the quay to which ships are tied with ropes.<dt>Dolphin<dd>A group of piles in the water that ships lean on.</dl></div><div class="ft">Terms of use</div></body>',
     ["Words of the port", "Dockers had their own words, some of which came from Dutch and Danish sailors.", "Bollard", "A thick post on the quay to which ships are tied with ropes.", "Dolphin", "A group of piles in the water that ships lean on."]),
    ("notice inside article", f'<body><main><article><h1>The old harbour</h1><div class="alert">Please enable scripts to see the map.</div>{p(T[:3])}<aside><h4>Read more</h4>{links("The lighthouse", "The ferry")}</aside>{p(T[3:])}<section class="comments"><h3>Comments</h3><div class="comment"><p>Nice one.</p></div></section></article></main></body>',
     ["The old harbour", *T]),
]
