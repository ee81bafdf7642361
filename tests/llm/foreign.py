"""Pages written by hand in the manner of common site software, with what a reader would call their main text."""

BLOG = """<!DOCTYPE html><html lang="en"><head><meta charset="utf-8"><title>Keeping bees in town | Roof Garden Notes</title><style>.x{color:red}</style></head>
<body class="post-template single single-post postid-91"><a class="skip-link screen-reader-text" href="#content">Skip to content</a>
<header id="masthead" class="site-header"><p class="site-title"><a href="/">Roof Garden Notes</a></p><nav id="site-navigation" class="main-navigation"><ul id="menu-main"><li class="menu-item"><a href="/">Home</a></li><li class="menu-item"><a href="/about">About</a></li><li class="menu-item"><a href="/contact">Contact</a></li></ul></nav></header>
<div id="content" class="site-content"><main id="main" class="site-main"><article id="post-91" class="post-91 post type-post hentry"><h1 class="entry-title">Keeping bees in town</h1>
<div class="entry-content"><p>Two years ago I put a single hive on the flat roof above our kitchen, and it has changed the way I look at the street below.</p><p>Lime trees, bramble on the railway bank and a neighbour&#8217;s lavender feed the colony from May to August; in a dry July they fly further than I expected.</p>
<h2>What it costs</h2><p>A hive, a suit and a smoker came to less than three hundred. The honey does not pay for it, and that was never the point.</p><ul><li>Check the mites every month.</li><li>Leave enough honey for the winter.</li></ul></div></article>
<div id="comments" class="comments-area"><h2 class="comments-title">2 thoughts on &ldquo;Keeping bees in town&rdquo;</h2><ol class="comment-list"><li class="comment"><div class="comment-content"><p>I tried this too and lost the first colony to wasps, so do watch out.</p></div><a class="comment-reply-link" href="#">Reply</a></li></ol><form id="commentform" class="comment-form"><label>Your name</label><input name="author"><button type="submit">Post Comment</button></form></div></main>
<aside id="secondary" class="widget-area sidebar"><section class="widget widget_recent_entries"><h2 class="widget-title">Recent Posts</h2><ul><li><a href="/1">Compost in a bucket</a></li><li><a href="/2">Rain barrels</a></li></ul></section></aside></div>
<footer id="colophon" class="site-footer"><div class="site-info">Proudly powered by software. &copy; 2023 Roof Garden Notes</div></footer><script>var a = "<p>no</p>";</script></body></html>"""

BLOG_TEXT = (
    "Keeping bees in town Two years ago I put a single hive on the flat roof above our kitchen, and it has changed the way I look at the street below. "
    "Lime trees, bramble on the railway bank and a neighbour’s lavender feed the colony from May to August; in a dry July they fly further than I expected. "
    "What it costs A hive, a suit and a smoker came to less than three hundred. The honey does not pay for it, and that was never the point. "
    "Check the mites every month. Leave enough honey for the winter."
)

NEWS = """<html><body><div class="top-bar"><span>Tuesday 4 June</span> <a href="/login">Sign in</a> <a href="/sub">Subscribe</a></div>
<div class="cookie-banner" role="dialog"><p>We use cookies to improve your visit. By going on you agree to our policy.</p><button>Accept all</button></div>
<nav class="navbar"><a href="/news">News</a> <a href="/sport">Sport</a> <a href="/weather">Weather</a></nav>
<div class="container"><div class="article-body" itemprop="articleBody"><h1>Ferry service to return after six years</h1>
<p>The ferry between the two harbours will sail again from next spring, the port authority said on Monday.</p>
<div class="ad-slot"><span>Advertisement</span></div>
<p>It last ran six years ago, when its owner closed the line for want of passengers. A new vessel, built for forty cars, is under way in a yard on the west coast.</p>
<p>“We have waited long enough,” said the mayor, who campaigned for the link and will be aboard for the first crossing.</p></div>
<div class="related-stories"><h3>Related stories</h3><ul><li><a href="/a">Harbour wall to be rebuilt</a></li><li><a href="/b">Fares to rise in autumn</a></li></ul></div>
<div class="newsletter-signup"><p>Get the morning briefing in your inbox.</p><form><input type="email"><button>Sign up</button></form></div></div>
<div class="footer"><a href="/terms">Terms of use</a> <a href="/privacy">Privacy</a> <p>All rights reserved.</p></div></body></html>"""

NEWS_TEXT = (
    "Ferry service to return after six years The ferry between the two harbours will sail again from next spring, the port authority said on Monday. "
    "It last ran six years ago, when its owner closed the line for want of passengers. A new vessel, built for forty cars, is under way in a yard on the west coast. "
    "“We have waited long enough,” said the mayor, who campaigned for the link and will be aboard for the first crossing."
)

HANDBOOK = """<HTML><HEAD><TITLE>Pump handbook</TITLE></HEAD><BODY BGCOLOR=white><TABLE WIDTH=100%><TR><TD CLASS=menu VALIGN=top><UL><LI><A HREF=index.htm>Index</A><LI><A HREF=parts.htm>Parts</A><LI><A HREF=order.htm>Order</A></UL></TD>
<TD CLASS=content><H1>Changing the seal</H1><P>Close the valve and let the pressure fall before you open the housing. Wear gloves, as the edges are sharp.<P>Lift the old seal with a wooden tool; a metal one would scratch the seat. Grease the new seal lightly and press it in with both thumbs.
<P>Open the valve slowly and look for drops. If there are any, the seal sits askew and must come out again.</TD></TR></TABLE><HR><ADDRESS>Copyright 1998, Pump Works. <A HREF="mailto:x">Webmaster</A></ADDRESS></BODY></HTML>"""

HANDBOOK_TEXT = (
    "Changing the seal Close the valve and let the pressure fall before you open the housing. Wear gloves, as the edges are sharp. "
    "Lift the old seal with a wooden tool; a metal one would scratch the seat. Grease the new seal lightly and press it in with both thumbs. "
    "Open the valve slowly and look for drops. If there are any, the seal sits askew and must come out again."
)

PAGES = [(BLOG, BLOG_TEXT), (NEWS, NEWS_TEXT), (HANDBOOK, HANDBOOK_TEXT)]
