"""Main text of web pages: flat text blocks, classified by a decision tree over shallow features of neighbours."""

from __future__ import annotations

import re
from functools import lru_cache
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import small_batches

# The tag and class names below are those of the HTML standard and of common page templates.
_BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
#: Their content is no markup: it ends at their own end tag alone.
_RAW = frozenset("script style title noscript iframe textarea noembed noframes xmp".split())
#: Elements whose text is no text of the page.
_HIDDEN = frozenset("select datalist button template svg math object canvas audio video".split())
_VOID = frozenset("hr img input meta link wbr col area base embed param source track".split())
#: A start tag of these ends an open paragraph.
_ENDS_P = _BLOCKS - frozenset("body caption head html legend tbody td tfoot th thead tr".split())
#: Elements whose end tag may be left out: what the start tag of each ends, and inside which box it looks for that.
_OPTIONAL = {"li": (("li",), ("ul", "ol", "menu", "dir")), "dd": (("dd", "dt"), ("dl",)), "dt": (("dd", "dt"), ("dl",)), "td": (("td", "th"), ("table",)), "th": (("td", "th"), ("table",))}
_OPTIONAL |= {"tr": (("tr",), ("table",))} | {n: (("thead", "tbody", "tfoot"), ("table",)) for n in ("thead", "tbody", "tfoot")}
_CELLS = frozenset("table caption td th".split())
_TABLE = frozenset("table caption thead tbody tfoot tr td th".split())
#: Elements beside the main text; a form may as well be a wrapper around the whole page.
_ASIDE = frozenset("aside dialog fieldset footer menu nav".split())
_TALK = re.compile(r"(?:^|[\W_])(?:comment(?:s|ary|list)?|discussions?|disqus|guestbook|replies|respond|responses|reviews|talkback)(?:$|[\W_])", re.I)
_SIDE = re.compile(r"(?:^|[\W_])(?:ads?|advert\w*|banner|breadcrumbs?|consent|cookies?|foot(?:er)?|gdpr|login|menu|modal|nav\w*|newsletter|notice|notification|pagination|popup|promo\w*|related|share|sharing|signup|social|sponsor\w*|subscribe|toolbar|widgets?)(?:$|[\W_])", re.I)
#: Names that pages give to a part as well as to a wrapper around it.
_LOOSE = re.compile(r"(?:^|[\W_])(?:form|search|side(?:bar)?|tags?)(?:$|[\W_])", re.I)
_TOP = re.compile(r"(?:^|[\W_])(?:head(?:er)?|masthead)(?:$|[\W_])", re.I)
_MAIN = re.compile(r"(?:^|[\W_])(?:article|content|entry|hentry|main|maintext|post|post-?body|story|text)(?:$|[\W_])", re.I)
_WRAP = re.compile(r"(?:^|[\W_])(?:container|grid|inner|layout|outer|page|wrap(?:per)?)(?:$|[\W_])", re.I)
#: A name that starts so tells of another part of the page, or what a text is about.
_SAID_OF = ("has-", "with-", "no-", "without-", "is-", "tag-", "category-", "comments-", "layout-")
#: Kinds of parts: a name that a main part inside it outweighs, a side part, readers' comments.
NO_PART, LOOSE, SIDE, TALK = range(4)
_ROLES = re.compile(r"""\s(?:class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s>"']+)""", re.I)
#: A comment, a declaration, or a tag: (slash, name, attributes). Quotes count after an equals sign alone, as in the
#: standard; no part is tried twice, so the time is linear in the page.
_TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*+(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>=]++|=\s*+(?:"[^"]*+"|'[^']*+')?+)*+)(?:>|\Z)""", re.S)

SHAPE = ("words", "links", "words_before", "links_before", "words_after", "links_after", "words_before_2", "links_before_2", "words_after_2", "links_after_2")
MARKUP = ("tags", "paragraph", "heading")
NAMES = ("side", "main")
FEATURES = SHAPE + MARKUP + NAMES


@lru_cache(maxsize=64)
def _end_of(name: str) -> re.Pattern:
    return re.compile(rf"</{re.escape(name)}\b[^>]*(?:>|\Z)", re.I)


@lru_cache(maxsize=4096)
def _part(name: str, roles: tuple[str, ...]) -> tuple[int, bool, bool]:
    """(kind of side part, a header, a main part), by the element's name and its class, id and role."""
    names = [n for x in roles for n in x.strip("\"'").split() if not n.lower().startswith(_SAID_OF)]
    main = name in ("article", "main") or any(map(_MAIN.search, names))
    if name in ("body", "html", "main"):
        return NO_PART, False, main
    if any(map(_TALK.search, names)):
        return TALK, False, main
    if name in _ASIDE or name != "article" and any(map(_SIDE.search, names)):
        return SIDE, False, main
    # a name of several parts and a wrapper (content-sidebar-wrap) is none of them
    loose = name == "form" or name != "article" and any(_LOOSE.search(n) and not (_MAIN.search(n) and _WRAP.search(n)) for n in names)
    return LOOSE if loose else NO_PART, name == "header" or any(map(_TOP.search, names)), main


class _Open:
    """The open elements, each with the part that its content belongs to; every element is put on and taken off once.

    The innermost named part counts. A `main` element ends any part around it but comments, since no side part may hold
    one; an `article` ends loose ones; a part that is only named like a main text ends a form.
    """

    def __init__(self):
        #: (name, kind of side part, in a main part, hidden, the loose part is a form)
        self.stack: list[tuple[str, int, bool, bool, bool]] = []
        self.at: dict[str, list[int]] = {}

    @property
    def state(self) -> tuple[int, bool, bool, bool]:
        return self.stack[-1][1:] if self.stack else (NO_PART, False, False, False)

    def last(self, names) -> int:
        return max((self.at[n][-1] for n in names if self.at.get(n)), default=-1)

    def put(self, name: str, roles: tuple[str, ...] = (), hidden: bool = False) -> None:
        kind, inside, silent, form = self.state
        if not hidden:
            own, top, main = _part(name, roles)
            if name == "main" or "main" in [r.strip("\"'") for r in roles if name == "div"] and own == NO_PART:
                kind = max(own, TALK if kind == TALK else NO_PART)
            elif main and own == NO_PART and (kind == LOOSE and (name == "article" or form)):
                kind = NO_PART
            elif own == NO_PART and top and not main and not inside:
                own = LOOSE
            if own > kind or own == LOOSE == kind:
                kind, form = own, name == "form"
            inside = inside or main
        self.at.setdefault(name, []).append(len(self.stack))
        self.stack.append((name, kind, inside, silent or hidden, form))

    def cut(self, size: int) -> None:
        while len(self.stack) > size:
            self.at[self.stack.pop()[0]].pop()

    def start(self, name: str) -> None:
        """Ends what the start tag of `name` ends: an open paragraph, the list item or cell before."""
        if name in _OPTIONAL:
            ended, box = _OPTIONAL[name]
            if (i := self.last(ended)) > self.last(box):
                self.cut(i)
        if name in _ENDS_P and (i := self.last(("p",))) > self.last(_CELLS):
            self.cut(i)

    def end(self, name: str) -> None:
        """Ends the last open `name`, unless a table's cell (or, for a list item, its list) lies between."""
        wall = ("table",) if name in _TABLE and name != "table" else () if name == "table" else ("ul", "ol", "menu", "dir") if name == "li" else _CELLS
        if (i := self.last((name,))) > self.last(wall):
            self.cut(i)


def blocks(html: str) -> list[tuple[str, float, bool, bool, bool, float, bool]]:
    """(text, link density, inside a side part, inside a main part, heading, inline tags a word, paragraph) of each text
    block in page order.

    A block ends at any block tag; inline tags and line breaks don't end it. Scripts, styles, comments and controls are
    left out; character references are decoded and white space becomes single blanks. End tags may be missing where the
    standard lets them. A block is inside a part if over half of its characters are. Linear in the page's length.
    """
    out, at, n, opened = [], 0, len(html), _Open()
    text: list[str] = []
    linked: list[str] = []
    inside = [0, 0, 0]  # characters, of side parts, of main parts
    anchor, tags, heading, paragraph = 0, 0, False, False

    def close():
        nonlocal tags
        words = "".join(text).split()
        if words:
            share = min(1.0, len("".join(linked).split()) / len(words))
            out.append((" ".join(words), share, inside[1] * 2 > inside[0], inside[2] * 2 > inside[0], heading, tags / len(words), paragraph))
        text.clear()
        linked.clear()
        inside[:] = 0, 0, 0
        tags = 0

    while at < n:
        m = _TAG.search(html, at)
        run = html[at : m.start()] if m else html[at:]
        kind, main, hidden, _ = opened.state
        if run and not hidden:
            run = unescape(run)
            text.append(run)
            if size := len(run.strip()):
                inside[0] += size
                inside[1] += size * (kind != NO_PART)
                inside[2] += size * main
            if anchor:
                linked.append(run)
        if not m:
            break
        at = m.end()
        name = (m[2] or "").lower()
        if not name:
            continue
        ending, rest = bool(m[1]), m[3]
        tags += not ending and name not in _BLOCKS
        if name in _RAW:
            if not ending:
                end = _end_of(name).search(html, at)
                at = end.end() if end else n
        elif name == "br":
            text.append(" ")
        elif name == "a":
            anchor = 0 if ending else 1
            linked.append(" ")
        elif name in _HIDDEN:
            if ending:
                opened.end(name)
            elif not (rest.endswith("/") and name in ("svg", "math")):
                opened.put(name, hidden=True)
            text.append(" ")
        elif name in _BLOCKS:
            close()
            anchor = anchor if name == "li" else 0
            heading = not ending and len(name) == 2 and name[0] == "h" and name[1].isdigit()
            paragraph = not ending and name == "p"
            if ending:
                opened.end(name)
            else:
                opened.start(name)
                if name not in _VOID:
                    opened.put(name, tuple(_ROLES.findall(rest)))
        elif name == "span":
            if ending:
                opened.end(name)
            else:
                opened.put(name, tuple(_ROLES.findall(rest)))
    close()
    return out


def features(found: list[tuple]) -> np.ndarray:
    """One row for each block; FEATURES names the columns. Missing neighbours have no words and no links."""
    words = np.array([len(b[0].split()) for b in found], dtype=np.float64)
    links = np.array([b[1] for b in found], dtype=np.float64)

    def shifted(x: np.ndarray, by: int) -> np.ndarray:
        out = np.zeros(len(x))
        if by > 0:
            out[by:] = x[:-by]
        elif by < 0:
            out[:by] = x[-by:]
        else:
            out[:] = x
        return out

    shape = [shifted(x, by) for by in (0, 1, -1, 2, -2) for x in (words, links)]
    return np.stack([*shape, *(np.array([b[i] for b in found], dtype=np.float64) for i in (5, 6, 4, 2, 3))], 1)


#: The labelled table, as pages: a block that starts with § is main text, any other is not.
LABELLED = (
    "<body><nav><ul><li><a href=/>Home</a></li><li><a href=/n>News</a></li><li><a href=/s>Sport today</a></li></ul></nav><div class=ad>Buy two pairs of shoes and get the third free this week only.</div><article><h1>§River levels fall after a dry spring</h1><p>§The river has fallen to its lowest level for twenty years, and farmers along its banks are worried about the summer.</p><p>§Rain is due.</p><p>§Officials said that they would meet again on Friday to decide whether water use has to be limited in the three towns.</p></article><footer>Copyright Example Press, all rights reserved.</footer></body>",
    "<body><header><h1>The Daily Example</h1><p>News from the valley since 1901</p></header><main><h2>§Bridge opens</h2><p>§After four years of work the new bridge opened to traffic this morning, a month before the date that had been planned.</p><p>§It cost <a href=x>eleven million</a>, a little less than was feared when the old one closed and the ferry had to be used.</p><p>§Cyclists cheered.</p></main><aside><h3>Most read</h3><p><a href=1>Ten ways to cook a pumpkin</a></p><p><a href=2>Storm warning for the coast</a></p><p>Sign up for our weekly letter and never miss a story about your town again.</p></aside><footer><p>Contact us by post or telephone on weekdays between nine and five.</p></footer></body>",
    "<body><div id=header>Example Forum</div><div id=menu><a href=1>Index</a> <a href=2>Members</a> <a href=3>Rules</a></div><div id=content><h1>§How to prune an apple tree</h1><p>§Prune in late winter, when the tree is at rest and the shape of its branches can be seen without any leaves.</p><p>§Cut out dead wood first, then branches that cross, and stand back often to look at the whole tree before the next cut.</p><p>§Good luck.</p></div><div class=comments><h3>Comments</h3><p>Thank you, this was really helpful and my tree looks much better than it did last year!</p><p>I disagree, summer is better for old trees in my experience of forty years of gardening.</p></div><div class=sidebar><p>About the author: a gardener who writes about trees, shrubs and hedges for several papers.</p></div><div id=footer>Powered by Example Software</div></body>",
    "<body><div>Menu: <a href=1>Start</a> <a href=2>Archive</a> <a href=3>About us</a> <a href=4>Contact</a></div><p>§The old mill was built of stone that was carried down from the hills by oxen, as the accounts of the abbey tell in detail.</p><p>§For two hundred years it ground the corn of the whole valley, until steam came and the miller's sons left for the city.</p><p>§Today a small museum shows how the wheel, the stones and the sieves worked together, and school classes bake bread there.</p><div><a href=5>Back to the overview</a> | <a href=6>Next page</a></div><div>Last changed on 3 May</div></body>",
    "<body><div class='cookie-notice'>We use cookies to make this site work and to measure how it is used. You can change your settings at any time.</div><nav><a href=1>Products</a><a href=2>Support</a></nav><article><header><h1>§Firmware 2.1 released</h1></header><p>§The update repairs an error by which the clock lost an hour at the change to summer time, and makes the start faster.</p><ul><li>§Faster start by about a third on older devices</li><li>§Clock error repaired</li></ul><p>§Install it from the settings page.</p></article><form><p>Leave your address and we tell you about new versions.</p><label>Name</label></form><footer><a href=3>Terms</a> <a href=4>Privacy</a></footer></body>",
    "<body><table><tr><td><a href=1>Section one</a></td><td><a href=2>Section two</a></td></tr></table><div class=post-body><p>§Yesterday we walked along the northern shore, where the wind had drawn long lines into the sand and the gulls stood in rows.</p><p>§Nobody spoke.</p><p>§In the evening the lights of the island went on one by one, and the last ferry crossed the bay with hardly anyone on board.</p></div><div class=related><h4>You may also like</h4><p><a href=3>Ten walks by the sea</a></p><p>A week on the island, with maps and a list of the best places to stay.</p></div><div class=share><a href=4>Share</a> <a href=5>Print</a></div></body>",
    "<body><nav><a href=1>Front page</a></nav><div class=banner>Sale ends tonight</div><article><h1>§Short note</h1><p>§Done.</p><p>§Yes.</p></article><footer>Example</footer></body>",
    "<body><div class=notice>This page will move to a new address at the end of the month, please change your bookmarks.</div><main><p>§Goats are kept on the steep meadows above the village from May until the first snow, and their milk is made into cheese.</p><p>§See <a href=1>the list of dairies</a> for those that can be visited.</p><ul><li><a href=2>Cheese of the north</a></li><li><a href=3>Cheese of the south</a></li></ul></main><section class=comments><p>Lovely article, we visited them last year and the children still talk about the goats and the view from the hut.</p></section></body>",
    "<body><p><a href=1>Skip to the text</a></p><h1>§On the weather of the high plain</h1><p>§Clouds come from the west in the afternoon, grow tall over the ridge, and bring short and heavy showers that end at sunset.</p><h2>§Winter</h2><p>§Snow lies from November to March, but seldom deeper than a hand, since the wind carries most of it down into the gorge.</p><p><a href=2>Home</a> <a href=3>Imprint</a></p></body>",
    "<body><header><a href=1>Logo</a><p>Your source for local facts and figures, updated every hour of the day</p></header><div class=promo>Subscribe now for only one coin a month and read everything without adverts.</div><div class=article><h2>§Council votes</h2><p>§The council voted by nine to four for the new school, which is to open in the autumn of next year on the site of the old dairy.</p><blockquote>§We have waited long enough.</blockquote><p>§Opponents had asked for a cheaper building.</p></div><div class=newsletter>Get the morning briefing by post every day before breakfast.</div><div class=tags><a href=2>school</a> <a href=3>council</a></div></body>",
    "<body><nav><a href=1>Top</a> <a href=2>All posts</a></nav><article><h1>§New oven</h1><p>§The bakery in the station road has a new oven, which takes twice as many loaves as the old one and needs less wood.</p><p>§Bread from six.</p></article><footer><a href=3>Imprint</a></footer></body>",
    "<body><ul><li><a href=1>Maps</a></li><li><a href=2>Trips</a></li></ul><main><h1>§Lakes</h1><p>§There are more than ninety lakes in the park.</p><p>§Read also <a href=3>the guide to the nine highest lakes</a></p></main><ul><li><a href=4>Rivers of the park and their sources in the hills</a></li></ul></body>",
    "<body><div><a href=1>Home</a> | <a href=2>Search the whole archive of this site</a></div><h1>§A letter from the harbour</h1><p>§The fleet came home on Tuesday with less than half the herring of last year, and two of the boats will not go out again.</p><p>§My brother has sold his share and wants to drive a bus, which I can't picture, but he says that the sea has become too quiet.</p><div><a href=3>Back to the list</a> | <a href=4>Forward to the next of these letters</a></div><div>Page made on 9 June</div><div>All rights reserved by the makers</div></body>",
    "<body><p><a href=1>Help</a> <a href=2>Sign in</a></p><p>§The census counted the swifts of the old town for the eleventh time, and found more nests than in any year since it began.</p><p>§Most of them are under the roofs of the four churches.</p><p><a href=3>Previous: counting the storks on the meadows</a></p><p>Printed 4 times</p></body>",
    "<body><nav><a href=1>A</a></nav><div class=advert>Win a week in the mountains for two.</div><article><h1>§Ice</h1><p>§Yes.</p><p>§The lake is frozen.</p></article><div class=ad>Cheap tyres here.</div></body>",
    "<body><div class=ad>Fresh fish every day from the quay, smoked or raw, delivered to your door before noon by our own vans in all of the towns.</div><article><h1>§The lamp in the tower burns again after the long repair of its lens</h1><p>§For a year ships had to find the channel by the two smaller lights on the breakwater, and more than one ran on the sand.</p></article><footer>Made by the harbour office of the county, with the help of the sailing club, the pilots and the school on the island, last changed in June.</footer></body>",
    "<body><nav>You are here: the whole site, then the part on birds, then the page on the birds of the coast and the islands, in the summer</nav><main><p>§Terns nest on bare gravel and will dive at anyone who walks too near, so the path is closed until the end of July.</p></main><aside>Our shop has field guides, maps, binoculars, hats and coats for every weather, and all that it earns goes to the wardens of the coast.</aside><footer>Wardens of the coast, a charity, with its seat at the old customs house by the bridge, open on every day but Monday from ten to four</footer></body>",
    "<body><header>The voice of the upper valley, its farms and its forests, printed on Thursdays and read in every house since the year of the great flood</header><article><p>§Hay was cut a week early.</p><p>§It is dry and smells sweet, and the barns are full to the roof, so that some of it was sold to the riding school by the lake.</p></article><div class=comments><p>We cut ours on the same day and had three men and a boy with us, and the weather held until the very last cart was in.</p><p>Same here.</p></div><form>Write what you think of this article, and give us your name and the town you live in, which will be printed with it.</form></body>",
    "<body><main><h1>§Snow in May</h1><p>§Half a metre fell in the night on the pass, and the road will stay closed until the plough comes back from the workshop.</p><div class=ad>Winter tyres at the price of summer tyres, only until the stock is sold, at all our branches.</div><p>§Sheep were brought down to the barns, though two are still missing.</p><aside>Have you taken pictures of the snow? Send them to our office and win a place in the calendar.</aside><p>§More is expected.</p><section class=comments><p>In my village the power failed for six hours and we sat by the stove and told old stories.</p><p>Great.</p></section></main></body>",
    "<body><article><nav><a href=1>Part one</a> of the series on mills</nav><h1>§The upper mill</h1><p>§Its wheel turns again, driven by a pump, and on Sundays the miller's niece grinds a sack of rye for the visitors to watch.</p><form><p>Type your postcode to find the mill that is nearest to your home</p></form><div class=comments><p>My grandfather worked there as a boy and always spoke of the cold, the dust and the noise.</p></div><footer>Filed under mills, by our reporter in the valley</footer></article></body>",
    "<body><nav><a href=1>Start</a></nav><article><h1>§Storm over the sound</h1><p>§Two ferries stayed in port, and the bridge was closed to lorries until the wind had turned to the north in the early evening.</p><p>§Nobody was hurt.</p></article></body>",
    "<body><p>§There was no school that day, so we took the small boat out to the rocks and caught nine mackerel before the fog came in.</p></body>",
    "<body><div><a href=1>Index of all letters</a></div><p>§Dear sister, the parcel came on Monday, whole and dry, and the children have already eaten most of the plums you sent.</p><p>§Write soon, and tell us how the roof was mended, and whether the new teacher has found a room in the village for the winter.</p></body>",
    "<body><main><p>§Closed.</p></main></body>",
    "<body><article><h1>§Frost</h1><p>§All the early pears were lost in one night, the growers say, and most of the plums on the lower slopes as well.</p><div class=comments><p>Ours too, though we had lit fires between the rows as my father used to do when I was small.</p></div></article></body>",
    "<body><article><h1>§Hall sold</h1><p>§The old dance hall by the quay, empty for nine years, has been bought by two brothers who want to open a cinema in it.</p><p>§The price has not been made public yet.</p></article></body>",
    "<body><nav><a href=1>Back</a></nav><main><h1>§The divers</h1><p>§They found the anchor, a bell and a great many bottles.</p><p>§They will be back in the spring with a new boat.</p></main></body>",
    "<body><nav><a href=1>World</a> <a href=2>Valley</a> <a href=3>Farms and markets</a> <a href=4>Weather</a> <a href=5>Sport</a> <a href=6>Letters to the editor</a> <a href=7>Births and deaths</a></nav><article><h1>§Bees</h1><p>§Most of the hives came through the winter well.</p></article><p><a href=1>More stories on bees, wasps and other insects from our reporters</a></p></body>",
    "<body><div class=menu><a href=1>Tables</a> <a href=2>Chairs</a> <a href=3>Beds for children</a> <a href=4>Lamps</a> <a href=5>Shelves</a> <a href=6>All of our offers this week</a></div><main><h2>§How we make a chair</h2><p>§The wood lies for three years before it is cut, and each leg is turned by hand from a piece without any knots.</p></main></body>",
    "<body><article><p>§It rains in the hills and will go on raining until Sunday.</p></article></body>",
    "<body><article><p>§The lift to the upper station stands still while its cable, which is older than most of its passengers, is replaced.</p><p>§Walkers can use the forest road, which has been cleared.</p></article></body>",
    "<body><div class=top><a href=1>Home</a> <a href=2>Recipes of the season</a> <a href=3>About the cook</a></div><div class='content-sidebar-wrap'><main><article><h1>§Plum cake</h1><p>§Stone the plums, halve them, and lay them in rows on the dough while the oven grows hot, with the cut side up.</p><p>§Bake for forty minutes.</p></article></main><div class=sidebar><div class=text><p>I cook for a family of six in a small house by the river, and write down what they like.</p></div></div></div></body>",
    "<body><form id=pageForm><div><a href=1>Departments</a> <a href=2>Forms and fees</a> <a href=3>Opening hours</a></div><div id=content><h2>§Road works</h2><p>§The lower road is closed between the church and the bridge from Monday on, and buses go by way of the station for two weeks.</p><p>§Residents may pass on foot.</p></div><div><a href=4>Imprint</a> <a href=5>Plain language</a></div></form></body>",
    "<body><div class='post hentry tag-politics'><h2>§On the vote</h2><p>§Nine in ten came to the hall, more than in any year since the new law, and most of them stayed until the votes were counted.</p><p>§Nobody shouted.</p></div><div id=comments><p>I was there too and can say that the coffee was cold but the talk was good and honest all the evening.</p></div><div><a href=1>Older posts</a> <a href=2>Newer posts</a></div></body>",
    "<body><article><h1>§A lamp for the desk</h1><p>§Its arm holds where it is put, and its light is warm enough for long evenings with a book and a pot of tea.</p></article><div class='user-reviews'><p>Bought two of them and both still work after a year of daily use in the office, I would buy a third.</p><p>Good.</p></div></body>",
    "<body><div><a href=1>Index</a></div><div><p>§The second chapter tells how the canal was dug by hand, from the lock at the mill to the basin behind the brewery.</p><p>§It took nine summers, and the names of the men are cut into the wall of the last lock.</p></div><div><a href=2>Chapter one, on the plans</a> <a href=3>Chapter three, on the boats</a></div></body>",
    "<body><main><h1>§Two owls</h1><p>§They sit in the barn all day and fly at dusk over the wet meadows, where the mice are fat in August.</p><section id=discussion><p>We have a pair as well, in the old oak by the pond, and hear the young ones hiss at night in June.</p></section></main></body>",
    "<body><p>§In the third winter the well froze, and water had to be carried up from the lake in pails, as the diary of the vicar tells.</p><p>§He gives the number of pails for each day, and for each day the name of whoever carried them, until the thaw came in March.</p><div>Made with care in a small town</div></body>",
)


def labelled_table() -> tuple[np.ndarray, np.ndarray]:
    """(features, labels) of all blocks of the labelled pages."""
    rows, labels = [], []
    for page in LABELLED:
        found = blocks(page)
        labels += [b[0].startswith("§") for b in found]
        rows.append(features([(b[0].lstrip("§"), *b[1:]) for b in found]))
    return np.concatenate(rows), np.array(labels)


def grow(x: np.ndarray, y: np.ndarray, depth: int = 10, shape_depth: int = 3, shape_least: int = 12):
    """A decision tree by Gini impurity: a share of positives, or (column, threshold, lower, higher).

    The first `shape_depth` levels may ask for words and links alone, in parts of at least `shape_least` rows; only
    what those leave mixed is asked for names as well.
    """
    share = float(y.mean())
    if depth == 0 or share in (0.0, 1.0) or len(y) < 2:
        return share
    best = None
    columns, least = (range(len(SHAPE)), shape_least) if shape_depth > 0 else (range(x.shape[1]), 1)
    for column in columns:
        values = np.unique(x[:, column])
        for threshold in (values[:-1] + values[1:]) / 2:
            low = x[:, column] <= threshold
            a, b = y[low], y[~low]
            if min(len(a), len(b)) >= least:
                impurity = sum(len(p) * p.mean() * (1 - p.mean()) for p in (a, b))
                if best is None or impurity < best[0] - 1e-12:
                    best = (impurity, column, float(threshold), low)
    if best is None:
        return grow(x, y, depth, 0) if shape_depth > 0 else share
    _, column, threshold, low = best
    return (column, threshold, *(grow(x[part], y[part], depth - 1, shape_depth - 1, shape_least) for part in (low, ~low)))


@lru_cache(maxsize=1)
def default_tree():
    return grow(*labelled_table())


def score(tree, row) -> float:
    while isinstance(tree, tuple):
        column, threshold, low, high = tree
        tree = low if row[column] <= threshold else high
    return tree


def by_shape(tree, row) -> bool:
    """Whether the tree's answer for the row rests on words, links and markup alone."""
    while isinstance(tree, tuple):
        column, threshold, low, high = tree
        if FEATURES[column] in NAMES:
            return False
        tree = low if row[column] <= threshold else high
    return True


def main_text(html: str | None, tree=None) -> str:
    """The blocks that the tree calls main text, in page order, joined by one newline; empty if there are none."""
    found = blocks(html or "")
    if not found:
        return ""
    tree = tree or default_tree()
    return "\n".join(b[0] for b, row in zip(found, features(found).tolist()) if score(tree, row) > 0.5)


def extract(pages: DataFrame, html_col: str = "html", out: str = "text") -> DataFrame:
    """`pages` without `html_col`, and `out` (the main text) and n_chars (its code points). One pass, no shuffle.

    Null or empty html: an empty text. Columns of these names in the input are replaced; repeated rows stay. No rows:
    no rows. A page is read whole by one task whatever its length, in linear time. A block
    for which the tree's leaf is undecided (one half) is left out.
    """
    kept = [c for c in pages.columns if c not in (html_col, out, "n_chars")]
    small_batches(pages.sparkSession)
    tree = default_tree()
    schema = pages.select(*kept).schema.add(out, "string").add("n_chars", "long")

    def run(batches):
        for batch in batches:
            for at in range(0, len(batch), 200):
                part = batch.slice(at, 200)
                texts = [main_text(h.as_py(), tree) for h in part.column(len(kept))]
                columns = [*part.columns[:-1], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, names=[*kept, out, "n_chars"])

    return pages.select(*kept, html_col).mapInArrow(run, schema)
