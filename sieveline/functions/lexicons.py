"""Keyword lists of scam vectors, and tables of them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# Keywords by vector, in order, that a sample is checked for consistency with its vector by.
CONSISTENCY = {
    "crypto_investment": ("crypto", "bitcoin", "btc", "eth", "ethereum", "token", "blockchain", "invest", "yield", "roi", "defi", "trading", "wallet", "exchange", "mining", "nft", "coin", "profit", "return", "stake", "airdrop", "usdt", "binance", "coinbase", "guaranteed", "portfolio", "deposit"),
    "romance_grooming": ("love", "darling", "dear", "sweetheart", "beautiful", "handsome", "lonely", "heart", "relationship", "romance", "widow", "military", "deployed", "marry", "feelings", "connection", "caring", "miss you", "attractive", "soul", "companion", "dating", "profile"),
    "tech_support": ("virus", "malware", "infected", "computer", "windows", "microsoft", "apple", "antivirus", "security", "firewall", "trojan", "hacked", "breach", "license", "expired", "renew", "subscription", "norton", "mcafee", "tech support", "error", "warning", "alert", "system", "software", "router"),
    "government_impersonation": ("irs", "tax", "social security", "ssn", "warrant", "arrest", "federal", "government", "department", "agent", "officer", "law", "enforcement", "fine", "penalty", "legal", "court", "subpoena", "immigration", "visa", "customs", "compliance", "authority", "investigation", "suspend", "revoke"),
    "lottery_reward": ("lottery", "winner", "prize", "reward", "congratulations", "won", "lucky", "draw", "jackpot", "claim", "sweepstake", "raffle", "selected", "million", "cash", "gift", "free", "award"),
    "urgency_payment": ("urgent", "overdue", "payment", "invoice", "bill", "wire", "transfer", "deadline", "immediate", "penalty", "late", "suspend", "cancel", "electricity", "utility", "account", "balance", "owe", "past due", "final notice", "disconnection"),
    "phishing": ("click", "link", "verify", "password", "account", "login", "confirm", "update", "suspend", "security", "unauthorized", "access", "credential", "expire", "unlock", "reset", "log in", "http", "www", "txt", "reply", "subscribe"),
    "remote_access": ("remote", "teamviewer", "anydesk", "screen", "control", "access", "desktop", "install", "download", "connect", "session", "fix", "technician", "support", "share", "software", "tool"),
}
# Keywords by vector, in order, that a text without a vector is given one by.
COLLECTION = {
    "crypto_investment": ("bitcoin", "crypto", "cryptocurrency", "btc", "eth", "ethereum", "investment", "profit", "returns", "wallet", "blockchain", "token", "trading", "forex", "binary option", "pig butchering"),
    "romance_grooming": ("love", "relationship", "dating", "girlfriend", "boyfriend", "partner", "meet", "soulmate", "lonely", "heart", "romantic", "affection"),
    "tech_support": ("microsoft", "apple", "windows", "virus", "malware", "infected", "tech support", "computer", "device", "firewall", "hacker", "remote access", "teamviewer", "anydesk"),
    "government_impersonation": ("irs", "social security", "ssn", "medicare", "government", "federal", "warrant", "arrest", "legal action", "tax", "ssa", "dhs", "fbi", "police", "officer", "court"),
    "lottery_reward": ("won", "winner", "lottery", "prize", "reward", "claim", "selected", "congratulations", "million", "lucky", "gift card"),
    "urgency_payment": ("urgent", "immediately", "account suspended", "payment due", "overdue", "last notice", "final warning", "act now", "expires", "limited time", "electricity", "utility"),
    "phishing": ("click here", "verify your", "confirm your", "account information", "password", "login", "credentials", "update your", "bank", "paypal", "amazon", "netflix", "ebay", "secure"),
    "remote_access": ("remote", "access", "anydesk", "teamviewer", "control", "screen share", "install", "download", "software", "refund", "overpaid"),
}


def table(spark: SparkSession, keywords: dict[str, tuple[str, ...]]) -> DataFrame:
    """(vector, keyword, position) of a lexicon, as Lexicon.from_table reads it; keep it as a table to change it without code."""
    rows = [(v, w) for v, words in keywords.items() for w in words]
    return spark.createDataFrame([(v, w, k) for k, (v, w) in enumerate(rows)], "vector string, keyword string, position int")
