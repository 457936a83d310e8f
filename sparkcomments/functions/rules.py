"""The rule table: spam signals and legitimacy signals as data.

A rule is plain data, so a user can extend a detector by passing a longer tuple
to :func:`sparkcomments.functions.scoring.analyze`.  Patterns are written in the
common subset of the Python, Java and RE2 dialects; ``patterns.java`` adapts
``\\s``, ``\\d`` and ``\\b`` to Unicode semantics.
"""

from __future__ import annotations

from dataclasses import dataclass

from .prefilter import prefilter

NORM = "norm"      # normalised text
RAW = "raw"        # text as posted
AUTHOR = "author"  # display name as posted


class _Pattern:
    """A rule's pattern, and what a text must hold for it to be tried.

    ``starts``, ``hints`` and ``probe`` only save work; where they are not given,
    they are derived from the pattern (see ``prefilter``).
    """

    def __post_init__(self) -> None:
        # Starts are looked for in the normalised text, in lower case.
        derived = prefilter(self.pattern, self.source == NORM and self.ignore_case)
        for name in ("starts", "hints", "probe"):
            if getattr(self, name) is None:
                object.__setattr__(self, name, getattr(derived, name))


@dataclass(frozen=True)
class Signal(_Pattern):
    """One spam signal.

    ``slot`` groups either/or rules: of the rules sharing a slot, only the first
    that hits counts.  ``label`` is what is reported as the match; ``None``
    reports the matched text itself.  ``counted`` makes the weight grow with the
    number of matches: base, step for each match, top.
    """

    id: str
    slot: str
    category: str
    signal: str
    weight: float
    source: str
    pattern: str
    label: str | None = None
    ignore_case: bool = True
    starts: tuple[str, ...] | None = None
    hints: tuple[str, ...] | None = None
    probe: str | None = None
    counted: tuple[float, float, float] | None = None


@dataclass(frozen=True)
class Legitimacy(_Pattern):
    """One pattern based legitimacy signal; ``bonus`` is negative."""

    id: str
    signal: str
    bonus: float
    source: str
    pattern: str
    label: str | None = None
    ignore_case: bool = True
    starts: tuple[str, ...] | None = None
    hints: tuple[str, ...] | None = None
    probe: str | None = None


# --------------------------------------------------------------------------
# Patterns, weights and texts that results depend on.
# --------------------------------------------------------------------------

SEED_PHRASE = r"\b(seed\s*phrase|recovery\s*phrase|mnemonic|12\s*words?|24\s*words?|multi.?sig(nature)?|help\s*(me\s*)?(transfer|withdraw|access)|share\s*\d+%|split\s*(the\s*)?(profit|funds)|stuck\s*(in\s*)?(wallet|exchange)|can't\s*(access|withdraw)|need\s*(help|gas|fee)\s*to\s*(transfer|withdraw))\b"
CRYPTO = r"\b(crypto|bitcoin|btc|ethereum|eth|altcoin|blockchain|nft|binance|coinbase|kraken|kucoin|bybit|okx|bitget|mexc|usdt|usdc|tether|dogecoin|doge|shiba|pepe|defi|yield\s*farm|staking|airdrop|whitelist|presale|web3|metaverse|token|ico|ido|forex|fx\s*trading|binary\s*option|trading\s*(signal|bot|group)|10x|100x|1000x|moon(ing)?|lambo|hodl|wagmi|ngmi|fomo|fud)\b"
FINANCIAL = r"(\$\d{1,3}(,?\d{3})*(\.\d{2})?\s*(per|a|every|each)?\s*(day|week|month|hour)|guaranteed\s*(returns?|profit|income)|double\s*your\s*(money|investment)|risk\s*free|no\s*risk|zero\s*risk|\d+%\s*(daily|weekly|monthly|roi|return|profit)|(turn|transform|convert)\s*\$?\d+\s*(into|to)\s*\$?\d+|(make|earn)\s*\$?\d+[kK]?\+?\s*(daily|weekly|monthly|passive)|passive\s*income|financial\s*freedom|quit\s*(your\s*)?(job|9.?5)|work\s*from\s*(home|anywhere).*\$)"
PLATFORM_REDIRECT = r"(t\.me/[a-zA-Z0-9_]+|wa\.me/\d+|chat\.whatsapp\.com/[a-zA-Z0-9]+|discord\.(gg|com/invite)/[a-zA-Z0-9]+|@[a-zA-Z0-9_]+\s*(on\s*)?(telegram|whatsapp|insta|ig))"
CONTACT = r"\b(contact|message|text|chat\s*with|reach|dm|pm|inbox)\s*(me|us|him|her)?\s*(on|at|via|through|@)?\s*(whatsapp|telegram|signal|wechat|line|viber|discord|instagram|ig|facebook|fb|twitter|x|tiktok|snapchat)?\b|\b(whatsapp|telegram|signal|discord)\s*(me|us|now|today|asap)?\b|\bsend\s*(a\s*)?(dm|pm|message)\b|\b(hit|slide\s*into)\s*(my|the)?\s*(dm|inbox)\b|\b(add|follow)\s*me\s*(on|@)\b"
PHONE = r"(\+\d{1,3}[-.\s]?\(?\d{1,4}\)?[-.\s]?\d{1,4}[-.\s]?\d{1,9})|(\(\d{3}\)\s*\d{3}[-.\s]?\d{4})|(\b\d{3}[-.\s]?\d{3}[-.\s]?\d{4}\b)|(\+\d{10,15}\b)"
EMAIL = r"[a-zA-Z0-9._%+-]+\s*(?:@|\[at\]|\(at\))\s*[a-zA-Z0-9.-]+\s*(?:\.|\[dot\]|\(dot\))\s*(com|org|net|io|co|info|biz|xyz)\b"
FAKE_PINNED = r"(📌|🔴|⬆️|👆|👇)?\s*(pinned\s*(by|comment|message)|official\s*(pinned|announcement|message)|^\s*📌.*pinned|read\s*my\s*pinned)"
BADGE = r"[✓✔✅☑🔵⚪🔘🔷💎⭐]"
AUTHOR_SUFFIX = r"(official|giveaway|telegram|team|real|verified|gaming|live|support|admin|help|bot|promo|moderator|mod|staff|vip)\s*$"
CHANNEL_PROMOTION = r"\b(check\s*(out)?|visit|see|view|watch|subscribe\s*(to)?|follow)\s*(my|our|the)?\s*(channel|page|profile|account|video|content|link)\b|\b(my|our)\s*(new\s*)?(channel|video|content|podcast)\b|\bsub(scribe)?\s*(to\s*)?(my|our|the)\b|\blink\s*(in|on)\s*(my\s*)?(bio|profile|description|about)\b|\b(i\s*(also\s*)?(make|create|post)|check\s*my)\s*(similar\s*)?(content|videos?)\b"
SELF_PROMOTION = r"\b(check\s*this\s*out|must\s*watch|you\s*need\s*to\s*see|click\s*(the\s*)?link|tap\s*(the\s*)?link|link\s*below|see\s*link|bio\s*link|support\s*(my|our)\s*(channel|content))\b"
BOOK_PROMOTION = r"\b(my\s*(new\s*)?(book|ebook|e-book|guide|course|program|masterclass)|(book|ebook)\s*(available|out\s*now|on\s*amazon|link)|get\s*(my|the|your)\s*(free\s*)?(copy|ebook|guide|book)|download\s*(my|the|your)?\s*(free\s*)?(guide|ebook|book|pdf)|(available|order|buy)\s*(now\s*)?(on\s*)?(amazon|kindle|audible)|#ad\b|#sponsored\b|#affiliate\b)\b"
SHORTENED_URL = r"\b(bit\.ly|tinyurl|t\.co|goo\.gl|ow\.ly|buff\.ly|rebrand\.ly|short\.link|linktr\.ee|cutt\.ly|rb\.gy|is\.gd|v\.gd|shorte\.st|adf\.ly|trib\.al|soo\.gd|s\.id)/[^\s]+\b"
URL = r"(https?://[^\s]+)|(www\.[^\s]+)|\b([a-zA-Z0-9-]+\.(com|org|net|io|co|info|biz|xyz|click|link|me)/[^\s]*)\b"
TEMPLATE = r"(\[name\]|\[product\]|\[link\]|\[url\]|\{.*?\}|<\s*insert\s*.*?\s*>|\[\s*your\s*.*?\s*\])"
BOT_PHRASE = r"\b(this\s*(video\s*)?changed\s*my\s*life|i\s*was\s*struggling\s*until|finally\s*found\s*(the\s*)?(solution|answer)|best\s*decision\s*i\s*(ever\s*)?made|wish\s*i\s*(had\s*)?(found|known)\s*(this|about\s*this)\s*sooner|this\s*is\s*exactly\s*what\s*i\s*needed|can't\s*believe\s*(this\s*)?(actually\s*)?works?|life\s*changing|game\s*changer|must\s*have|must\s*try|i\s*started\s*(and|then)\s*never\s*looked\s*back)\b"
ADULT = r"\b(onlyfans|of\s*link|18\+|adult\s*content|xxx|porn|nude|nudes|sexy\s*(pics?|photos?|videos?)|dating\s*(site|app)|hookup|s[e3]x(y|ting)?|h[o0]rny|(check|see)\s*(my|the)\s*(profile|bio)\s*[;)😉🔥💋])\b"
ENGAGEMENT_BAIT = r"\b(like\s*if\s*you|comment\s*if\s*you|who(\s*else)?\s*(is\s*)?(here|watching)\s*(in\s*)?20\d{2}|like\s*this\s*comment\s*(if|so)|anyone\s*(else\s*)?(here\s*)?(in|from)\s*20\d{2}|^first[!\.\s]*$|^second[!\.\s]*$|^third[!\.\s]*$|early\s*squad|notification\s*squad|who'?s\s*(still\s*)?(watching|listening)\s*(this\s*)?(in\s*)?20\d{2})\b"
TIMESTAMP = r"\b(\d{1,2}:\d{2}(:\d{2})?)\b|\bat\s*(\d{1,2}:\d{2})|timestamp|timecode"
REPLY = r"^@[a-zA-Z0-9_]+\s"
QUESTION = r"\?\s*$|\b(how|what|why|when|where|who|which|whose|whom|can\s*(you|i|we|someone)|could\s*(you|i|we)|would\s*(you|i|we)|should\s*(i|we)|does\s*(anyone|somebody|this)|has\s*(anyone|somebody)|is\s*(there|this|it)|are\s*(there|these)|what'?s|where'?s|who'?s|how'?s)\b"
DISCUSSION = r"\b(i\s*think|in\s*my\s*opinion|imo|imho|i\s*(agree|disagree)|great\s*(point|video|content|explanation|tutorial)|thanks?\s*(for|so\s*much)|thank\s*you|this\s*(helped|explains|clarifies)|i\s*(learned|understood|finally\s*(get|understand))|good\s*(job|work|explanation)|well\s*(explained|done|said)|helpful|informative|insightful|i'?ve\s*been\s*(struggling|trying|working)|as\s*a\s*(beginner|student|developer|teacher|parent))\b"
BALANCED = r"\b(but\s*(i\s*think|maybe|however)|one\s*(thing|suggestion|critique)|could\s*(be|have\s*been)\s*(better|improved)|i\s*(would\s*)?(suggest|recommend)|(slight|minor|small)\s*(issue|problem|critique)|not\s*sure\s*(about|if)|on\s*the\s*other\s*hand)\b"
EDUCATIONAL = r"\b(what\s*is|how\s*(does|do|to)|explain|learn(ing)?\s*about|understand(ing)?|teach|tutorial|guide|beginner|newbie|noob|started\s*learning|can\s*someone\s*explain|eli5|difference\s*between|compared\s*to|pros?\s*and\s*cons?|advantages?\s*and\s*disadvantages?)\b"

# The keyword rule scales with the number of hits: base + step * hits, at most top.
CRYPTO_BASE, CRYPTO_STEP, CRYPTO_TOP = 0.35, 0.08, 0.65


SIGNALS: tuple[Signal, ...] = (
    Signal("S02", "S02", "seed_phrase_scam", "Seed phrase / wallet scam pattern", 0.75, NORM, SEED_PHRASE),
    Signal("S03", "S03", "crypto_scam", "Crypto/trading keywords", CRYPTO_TOP, NORM, CRYPTO,
           counted=(CRYPTO_BASE, CRYPTO_STEP, CRYPTO_TOP)),
    Signal("S04", "S04", "financial_scam", "Financial promises/guarantees", 0.60, NORM, FINANCIAL),
    Signal("S05a", "S05", "platform_redirect", "Platform redirect link", 0.55, NORM, PLATFORM_REDIRECT),
    Signal("S05b", "S05", "contact_solicitation", "Contact solicitation", 0.45, NORM, CONTACT),
    Signal("S06", "S06", "contact_solicitation", "Phone number detected", 0.40, RAW, PHONE, "[phone number]", False),
    Signal("S07", "S07", "contact_solicitation", "Email address detected", 0.20, NORM, EMAIL, "[email]"),
    Signal("S08", "S08", "fake_pinned", "Fake pinned comment pattern", 0.65, NORM, FAKE_PINNED),
    Signal("S09", "S09", "impersonation", "Fake verification badge in username", 0.50, AUTHOR, BADGE, "[badge character]", False),
    Signal("S10", "S10", "impersonation", "Suspicious username suffix", 0.25, AUTHOR, AUTHOR_SUFFIX),
    Signal("S11", "S11", "channel_promotion", "Channel/profile promotion", 0.40, NORM, CHANNEL_PROMOTION),
    Signal("S12", "S12", "self_promotion", "Self-promotion phrases", 0.30, NORM, SELF_PROMOTION),
    Signal("S13", "S13", "book_promotion", "Book/product promotion", 0.45, NORM, BOOK_PROMOTION),
    Signal("S14a", "S14", "phishing", "Shortened URL (suspicious)", 0.40, NORM, SHORTENED_URL),
    Signal("S14b", "S14", "self_promotion", "URL detected", 0.15, NORM, URL, "[url]"),
    Signal("S15a", "S15", "bot_pattern", "Template markers detected", 0.70, NORM, TEMPLATE),
    Signal("S15b", "S15", "bot_pattern", "Generic bot-like phrase", 0.20, NORM, BOT_PHRASE),
    Signal("S16", "S16", "adult_content", "Adult/inappropriate content", 0.60, NORM, ADULT, "[adult content]"),
    Signal("S17", "S17", "engagement_bait", "Engagement bait", 0.15, NORM, ENGAGEMENT_BAIT),
)

LEGITIMACY: tuple[Legitimacy, ...] = (
    Legitimacy("L1", "Video timestamp reference", -0.25, RAW, TIMESTAMP, None, False),
    Legitimacy("L2", "Reply to specific user", -0.15, RAW, REPLY, "[@username]", False),
    Legitimacy("L3", "Asks a question", -0.15, NORM, QUESTION, "[question]"),
    Legitimacy("L4", "Genuine discussion", -0.20, NORM, DISCUSSION),
    Legitimacy("L5", "Balanced feedback", -0.10, NORM, BALANCED),
    Legitimacy("L6", "Educational context", -0.20, NORM, EDUCATIONAL),
)
