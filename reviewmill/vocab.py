"""Dictionaries, phrase lists and names that results depend on."""

# Fixed values, in their published order.
COMPONENTS = [
    "battery", "screen", "display", "charger", "cable", "bluetooth", "wifi", "wi-fi", "speaker", "microphone", "mic",
    "camera", "lens", "keyboard", "mouse", "trackpad", "touchpad", "port", "usb", "hdmi", "adapter", "plug", "power",
    "button", "hinge", "fan", "processor", "cpu", "gpu", "memory", "ram", "storage", "ssd", "hard drive",
    "motherboard", "sensor", "antenna", "remote", "controller",
]

# The full issue dictionary.
ISSUES = [
    "broke", "broken", "cracked", "scratched", "dent", "dented", "bent", "loose", "peeling", "chipped", "shattered",
    "torn", "worn out",
    "defective", "faulty", "malfunction", "malfunctioning", "dead", "garbage", "junk", "trash", "useless",
    "worthless", "terrible", "awful", "horrible",
    "stopped working", "not working", "doesn't work", "does not work", "did not work", "won't turn on",
    "won't charge", "won't connect", "will not work", "stopped charging", "not charging", "died", "discharged",
    "drains", "drain fast", "short battery life",
    "overheating", "overheat", "overheats", "runs hot", "gets hot", "slow", "laggy", "lag", "lagging", "sluggish",
    "freezing", "freeze", "froze", "unresponsive", "crash", "crashed", "crashes", "crashing", "glitchy", "glitch",
    "buggy",
    "disconnecting", "disconnect", "disconnects", "keeps disconnecting", "drops connection", "no signal",
    "weak signal", "poor signal", "won't pair", "not connecting", "keeps dropping",
    "flickering", "flicker", "dim", "blurry", "pixelated", "dead pixels", "noise", "noisy", "buzzing", "static",
    "distorted", "no sound", "muffled", "echo",
    "leak", "leaking", "leaked", "water damage",
    "too small", "too big", "too large", "too tight", "doesn't fit", "does not fit", "wrong size",
    "false advertising", "misleading", "not as described", "not as advertised", "looks nothing like",
    "cheaply made", "cheap quality", "poor quality", "low quality", "flimsy",
    "arrived damaged", "arrived broken", "missing parts", "wrong item", "wrong product", "incomplete",
    "never arrived", "late delivery",
    "refund", "return", "returned", "waste of money", "rip off", "ripoff", "scam",
]

# The reduced issue dictionary (same components).
REDUCED_ISSUES = [
    "broke", "broken", "cracked", "defective", "faulty", "malfunction", "dead", "garbage", "junk", "useless",
    "stopped working", "not working", "doesn't work", "does not work", "won't turn on", "won't charge",
    "overheating", "slow", "laggy", "freezing", "crash", "crashed", "glitchy", "disconnecting", "disconnect",
    "keeps disconnecting", "flickering", "dim", "noise", "noisy", "buzzing", "static", "distorted", "loose", "bent",
    "scratched", "leak", "leaking", "died", "discharged", "drains", "unresponsive", "arrived damaged",
    "missing parts", "wrong item", "late delivery", "never arrived", "misleading", "not as described",
    "cheaply made", "poor quality", "flimsy", "too small", "too big", "doesn't fit", "waste of money", "rip off",
    "scam", "overpriced",
]

# Substrings counted by the complaint score.
COMPLAINT_KEYWORDS = [
    "broken", "defective", "terrible", "worst", "awful", "horrible", "waste", "garbage", "trash", "scam", "fake",
    "cheap", "flimsy", "useless", "disappointing", "refund", "return",
]

# Substrings that mark a review as shipping-related.
SHIPPING_PHRASES = [
    "arrived damaged", "arrived broken", "wrong item", "missing parts", "late delivery", "shipping", "package",
    "packaging", "box was", "never arrived", "never received", "wrong product", "damaged in transit",
]

# Root-cause labels, judge criteria and model features, in output order.
LABELS = ["defect", "shipping", "description", "size", "price"]
CRITERIA = ["accuracy", "completeness", "actionability", "conciseness"]
FEATURES = ["daily_sentiment_avg", "review_velocity", "negative_ratio", "complaint_keywords"]

# Phrases of the first rule set (0.3 each).
RULES_V1 = {
    "defect": ["broken", "defective", "malfunction", "dead", "stopped working", "not working", "crashed",
               "overheating", "freezing"],
    "shipping": ["arrived damaged", "missing parts", "wrong item", "late delivery", "never arrived"],
    "description": ["misleading", "not as described", "false advertising", "cheaply made", "poor quality"],
    "size": ["too small", "too big", "doesn't fit", "wrong size"],
    "price": ["waste of money", "overpriced", "rip off", "scam"],
}

# Phrases of the second rule set (0.2 each).
RULES_V2 = {
    "defect": ["broke", "broken", "cracked", "defective", "faulty", "malfunction", "dead", "died",
               "stopped working", "not working", "doesn't work", "does not work", "won't turn on", "won't charge",
               "overheating", "overheat", "slow", "laggy", "freezing", "crash", "crashed", "glitchy", "buggy",
               "discharged", "drains", "unresponsive"],
    "shipping": ["arrived damaged", "arrived broken", "missing parts", "wrong item", "wrong product",
                 "late delivery", "never arrived", "incomplete", "damaged in transit"],
    "description": ["misleading", "not as described", "not as advertised", "false advertising", "cheaply made",
                    "cheap quality", "poor quality", "low quality", "flimsy", "looks nothing like",
                    "doesn't match", "does not match", "description", "listing"],
    "size": ["too small", "too big", "too large", "too tight", "doesn't fit", "does not fit", "wrong size"],
    "price": ["waste of money", "overpriced", "rip off", "ripoff", "scam", "not worth", "worthless"],
}

# Time units recognised in time references.
TIME_UNITS = ["second", "minute", "hour", "day", "week", "month", "year"]

# A short English stop-word list for word counts; callers may pass their own.
STOP_WORDS = ["a", "an", "and", "as", "at", "by", "for", "in", "is", "it", "of", "on", "or", "the", "to", "with"]
