"""The finance dictionary, hedge patterns and keyword rules, as data.

Operators take a lexicon (category -> words) as a parameter; FINANCE is the built-in one. from_csv() in
tonefold.sources reads a master dictionary instead.
"""

from __future__ import annotations

# The built-in finance dictionary, by category, in alphabetical order.
_WORDS = {
    "negative": """
        abandon abandonment abrupt absence abuse adverse adversely allegations alleged anomaly attrition backlog
        bankruptcy below breach burden cancel cancellation ceased charges claim collapse complaint concern concerns
        conflict controversy crisis critical decay decline declining default defaulted deficiencies deficiency deficit
        delay delays deteriorate deteriorating deterioration difficulties difficulty discontinued dispute disruption
        downturn downward eliminate elimination errors excessive exposure fail failed failing failure falling fines
        force fraud harm harmed harmful impair impaired impairment inability inadequate ineffective inefficiency
        infringement insolvency interrupt interruption investigate investigation judgment lapse late layoff layoffs
        legal liability liquidate liquidation litigation loss losses lower lowered material materiality misconduct
        negative noncompliance obsolete obstacle penalties penalty poor problems prosecution recall recession reduce
        reduced reduction regulatory reject rejection restatement restructure restructuring risk risks setback severe
        short shortage shutdown slow slowdown stagnation threat troubled uncertain unfavorable unprofitable
        unsatisfactory violation volatility vulnerability weak weakness write-off writedown writeoff
    """,
    "positive": """
        accelerate accomplish achievement advance advantage appealing attractive awarded beneficial benefit best
        breakthrough capture committed competitive confidence confident consistent continued delivering demonstrated
        distinguished diverse diversity effective effectively efficiency efficient enhance enhanced exceeded exceeding
        excellent exceptional expanding extraordinary favorable gain generate generating growth healthy improve improved
        improvement increasing innovate innovation innovative leadership leading leverage margin momentum operating
        opportunity outperform outstanding overachieve overcome performing positive profit profitability profitable
        profitably progress promising proven record reliable resilient robust solid strategic streamline strength strong
        success successful successfully sustainable transforming value win winning
    """,
    "uncertainty": """
        ambiguity ambiguous anticipate anticipated approximately assume assumed assumption assumptions belief believe
        believed conditional contingency contingent could debris depend depending doubt doubtful estimate estimated
        estimates estimating eventually expect expected expecting fluctuate fluctuating fluctuation forecasted future
        generally guess hedged hedging hope hopefully if imprecise indefinite indeterminate inexact may might outlook
        pending perhaps planned possibility possible possibly potential potentially projected projections roughly seem
        should speculative subject suppose target targeted tend tentative uncertain uncertainty unclear unknown
        unpredictable variable varies varying volatile volatility whether will
    """,
    "litigious": """
        adjudicate allegation alleged arbitration claim claims complaint compliance court criminal damages defendant
        deposition enforcement examine fine fines fraud grievance hearing illegal indictment infringement injunction
        inquiry inspect investigation judgment lawsuit legal liability liable litigant litigate litigation misconduct
        penalty plaintiff proceeding prosecute prosecution regulatory restitution settlement statute subpoena sue sued
        summons tribunal verdict violation
    """,
    "strong_modal": """
        always certain certainly clearly commit committed definitely ensure guarantee mandatory must necessarily need
        obligate obligation require required requirement requires shall undoubtedly will
    """,
    "weak_modal": """
        almost appear approximately around assume belief believe could depending doubt eventually generally hope if
        likely may might often perhaps possibly potentially probably roughly seem should sometimes subject tend
        typically uncertain usually whether would
    """,
    "constraining": """
        bound cap capped ceiling constrained constraint covenant curtail exclude exclusion forbid governed hinder impede
        limit limitation limited mandatory obligated obligatory prevented prohibited prohibition restrict restricted
        restriction subject threshold
    """,
}

Lexicon = dict[str, list[str]]
FINANCE: Lexicon = {category: words.split() for category, words in _WORDS.items()}
CATEGORIES = tuple(FINANCE)
#: Categories whose words hedge.
HEDGE_CATEGORIES = ("uncertainty", "weak_modal", "constraining")


def hedge_words(lexicon: Lexicon = FINANCE) -> list[str]:
    """The union of the hedge categories, sorted."""
    return sorted({w for c in HEDGE_CATEGORIES for w in lexicon.get(c, [])})


# Hedge phrases as regular expressions, in the order in which hits are listed.
HEDGE_PATTERNS = [
    r"\bwe\s+expect\b",
    r"\bsubject\s+to\b",
    r"\bif\s+conditions\s+permit\b",
    r"\bwe\s+believe\b",
    r"\bwe\s+anticipate\b",
    r"\bcould\s+be\b",
    r"\bmight\s+be\b",
    r"\bpotentially\b",
    r"\bapproximately\b",
    r"\baround\s+\$?\d",
    r"\bup\s+to\b",
    r"\bdepending\s+on\b",
    r"\bmarket\s+conditions?\b",
    r"\buncertain(ty)?\b",
    r"\bforward.looking\b",
    r"\bbased\s+on\s+current\b",
    r"\bsubject\s+to\s+change\b",
    r"\bassuming\b",
    r"\bgiven\s+(that|the)\b",
    r"\brisks?\s+(and|&)\s+uncertainties\b",
    r"\bmay\s+(or\s+may\s+not|not)\b",
    r"\bno\s+guarantee\b",
    r"\bcannot\s+be\s+assured\b",
    r"\bthere\s+(can|can't|cannot)\s+be\s+no\s+assurance\b",
]

# Phrases of several words that the span matcher looks for besides single hedge words.
HEDGE_PHRASES = [
    "we expect", "subject to", "if conditions permit", "we believe", "we anticipate", "could be", "might be", "up to", "depending on",
    "market conditions", "based on current", "subject to change", "given that", "no guarantee", "cannot be assured",
]
#: Words of the longest of them.
LONGEST_PHRASE = max(len(p.split()) for p in HEDGE_PHRASES)

# Roles, section markers and boilerplate of transcripts.
ROLE_KEYWORDS = {
    "operator": ["operator", "conference operator", "please go ahead", "your line is open", "thank you for joining"],
    "ceo": ["chief executive officer", "ceo", "president and ceo"],
    "cfo": ["chief financial officer", "cfo", "chief financial"],
    "analyst": [
        "analyst", "research", "bank", "capital", "morgan", "goldman", "jpmorgan", "barclays", "ubs", "citi", "deutsche",
        "credit suisse", "raymond james", "piper", "needham", "baird",
    ],
}
QA_MARKERS = ["question-and-answer", "q&a", "q & a", "we will now begin the question-and-answer", "we will now take questions"]
REMARKS_MARKERS = ["prepared remarks", "management discussion", "opening remarks", "good morning", "good afternoon", "good evening"]
BOILERPLATE = [
    r"^\s*$", r"forward.looking statements", r"this transcript has been", r"copyright \d{4}", r"all rights reserved",
    r"the information in this", r"^\s*\[?\s*applause\s*\]?\s*$", r"^\s*\[?\s*laughter\s*\]?\s*$", r"operator\s+instructions",
    r"please\s+stand\s+by", r"^page \d+ of \d+$",
]
HEADER = r"^([A-Z][a-zA-Z\s\-\.']{2,50})(?:\s*[-–—:]\s*([^-\n]{0,80}))?\s*[:-]?\s*$"

# Weights of the confidence score and of the composite signal; return windows in trading rows.
CONFIDENCE = {"certainty": 0.35, "specificity": 0.25, "hedge": 0.25, "tone": 0.15}
ALPHA = {"sentiment": 0.40, "confidence": 0.30, "hedge": 0.20, "tone": 0.10}
HORIZONS = (1, 3, 5)
SIGNALS = ("confidence_score", "qa_sentiment", "hedge_density", "ceo_cfo_divergence")
