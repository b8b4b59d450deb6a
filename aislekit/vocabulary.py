"""Words, phrases, templates and numbers that results depend on.

They are data, not logic: changing one changes what the jobs return.
"""

from __future__ import annotations

# Target categories and the raw names that belong to each.
TARGET_CATEGORIES = [
    "Home_and_Kitchen",
    "Grocery_and_Gourmet_Food",
    "Arts_Crafts_and_Sewing",
    "Health_and_Household",
    "Tools_and_Home_Improvement",
]
RAW_CATEGORY_NAMES = {
    "Home_and_Kitchen": [
        "home_and_kitchen", "kitchen_and_dining", "home_improvement", "patio_lawn_and_garden",
    ],
    "Grocery_and_Gourmet_Food": ["grocery_and_gourmet_food", "food_and_beverage"],
    "Arts_Crafts_and_Sewing": ["arts_crafts_and_sewing", "arts_and_crafts"],
    "Health_and_Household": [
        "health_and_household", "beauty_and_personal_care", "all_beauty", "health_and_beauty",
        "personal_care_appliances", "baby_products",
    ],
    "Tools_and_Home_Improvement": [
        "tools_and_home_improvement", "automotive", "industrial_and_scientific", "tools",
    ],
}

# Sizes and limits.
CONTEXT_SIZE = 8
TOP_K = 8
RAW_ROW_CAP = 1_000_000
LIBRARY_ROWS = 108_000
LATENCY_TARGET_SECONDS = 2.0

# Topic words for routing shopper questions.
SHIPPING_WORDS = [
    "ship", "shipping", "delivery", "deliver", "arrive", "arrival", "eta", "etas",
    "how long", "when will", "lead time", "transit time", "ship time", "delivery time",
    "express", "overnight", "standard shipping", "expedited", "prime shipping", "same day", "next day",
]
RETURN_WORDS = [
    "return", "refund", "exchange", "policy", "returning", "returns", "refunds", "exchanges",
    "return window", "restocking", "restocking fee", "money back", "can I return", "how to return",
    "return period", "return policy", "warranty", "guarantee",
]
SHORT_SHIPPING_WORDS = ["ship", "shipping", "delivery", "deliver"]
SHORT_RETURN_WORDS = ["return", "refund", "exchange", "policy"]
QUERY_CATEGORY_WORDS = {
    "Health_and_Household": ["health", "vitamin", "skincare", "moisturizer", "cleanser", "personal care"],
    "Home_and_Kitchen": ["kitchen", "cookware", "dinnerware", "appliance", "cooking", "food"],
    "Tools_and_Home_Improvement": ["tool", "drill", "hardware", "power tool", "safety", "measuring"],
    "Grocery_and_Gourmet_Food": ["food", "grocery", "coffee", "snack", "organic", "beverage"],
    "Arts_Crafts_and_Sewing": ["art", "craft", "sewing", "painting", "paint", "crayola", "creative"],
}
DEFAULT_QUERY_CATEGORY = "Home_and_Kitchen"
SHIPPING_TAGS = ["[TOOL: get_shipping_speed]", "[TOOL:get_shipping_speed]"]
RETURN_TAGS = ["[TOOL: get_return_policy]", "[TOOL:get_return_policy]"]
TOOL_RESULT = "Tool result: "
TOOL_INSTRUCTION = "Please provide a concise, helpful answer based on the tool result."
NO_INFORMATION = "Sorry, I couldn't find the information."
NO_PRODUCTS = "No products found in the database."
PRODUCTS_PREFIX = "Available products: "
CONTEXT_INTRO = "Here are some products that might help:"
NO_MATCH_INTRO = "I couldn't find any products matching your request in our store."

# Patterns of special tokens and words in a model reply.
TOKEN_PATTERNS = [r"[|]end[^|\n]*[|]", r"<[|][^>]*[|]>"]
STOP_PATTERN = r"(?iU)\bSTOP\.?\b"
FINISHED_PATTERN = r"(?iU)\bfinished\.?\b"

# Marks that close a model reply, in the order they are stripped.
STOP_MARKS = ["|stop|", "| Stop |", "| Finish |", "STOP", "END", "Finish", "Stop"]
FILLER_OPENINGS = [
    "Would you like", "Do you need", "Can I help", "Is there anything", "Anything else", "Let me know",
    "Please let me", "Feel free to", "If you have", "If you need", "If you want", "If you're looking",
    "If you're interested", "Any questions",
]
FILLER_SENTENCES = [
    "I see you provided", "I will provide", "Please note that shipping times may vary",
]
DANGLING_WORDS = ["What", "How", "Why", "Where", "When", "Which"]

# Phrases that mark a failed reply.
ERROR_PHRASES_WIDE = [
    "error", "not available", "cannot find", "unable to", "sorry", "apologize", "unfortunately", "failed",
]
ERROR_PHRASES_NARROW = ["error", "not available"]

# Words that decide the intent of a question, in test order.
PRICE_INTENT = ["price", "cost", "much", "expensive"]
RATING_INTENT = ["rating", "rated", "stars", "review"]
BRAND_INTENT = ["brand", "makes", "company", "manufacturer"]
CHECK_OPENINGS = ["is ", "does ", "has "]
SHIPPING_INTENT = ["shipping", "delivery", "ship", "deliver"]
RETURN_INTENT = ["return", "refund", "policy"]

# Words that decide the reported query type, in test order.
PRICE_TYPE = ["price", "cost", "much"]
RATING_TYPE = ["rating", "rated"]
BRAND_TYPE = ["brand", "makes", "company", "produces"]
SHIPPING_TYPE = ["ship", "shipping", "delivery", "deliver"]
RETURN_TYPE = ["return", "refund", "policy"]
CHECK_TYPE = ["is", "does", "has"]

# Patterns for facts in a reply.
PRICE_PATTERNS = [
    r"\$\d+(?:\.\d{2})?",
    r"\d+(?:\.\d{2})?\s*dollars?",
    r"price[:\s]*\$?\d+(?:\.\d{2})?",
]
RATING_PATTERNS = [
    r"\d+(?:\.\d+)?\s*(?:stars?|out of 5)",
    r"rating[:\s]*\d+(?:\.\d+)?",
    r"\d+(?:\.\d+)?\/5",
]
BRAND_PATTERNS = [
    r"brand[:\s]*([A-Za-z][A-Za-z0-9\s&]+)",
    r"made by\s+([A-Za-z][A-Za-z0-9\s&]+)",
    r"manufactured by\s+([A-Za-z][A-Za-z0-9\s&]+)",
]

# Words looked for when scoring replies.
CHECKED_FEATURES = [
    "organic", "gluten free", "dishwasher safe", "heavy duty", "professional grade", "ergonomic", "durable",
    "gentle", "fragrance free", "bpa free", "non-stick", "easy clean", "healthy", "natural", "non-gmo",
]
YES_WORDS = ["yes", "indeed", "correct", "true"]
NO_WORDS = ["no", "not", "false", "incorrect"]
SHIPPING_REPLY_WORDS = ["shipping", "delivery", "days", "express", "overnight", "standard"]
RETURN_REPLY_WORDS = ["return", "policy", "window", "condition", "restocking"]

# Fixed value: the fault of a run without a question.
NO_QUESTION = "'NoneType' object has no attribute 'lower'"

# Reasons for a chat row to fail, in test order.
BAD_JSON = "invalid JSON"
NOT_OBJECT = "Row is not a JSON object"
NO_MESSAGES = "Missing or invalid 'messages' list"
TOO_SHORT = "'messages' must have at least 3 entries (system, user, assistant)"
WRONG_ROLES = "First three roles must be system, user, assistant"
NOT_STRING = "Message {i} missing string role/content"
EMPTY_CONTENT = "Message {i} content is empty"

# Templates of the list task.
PICK_LIST_STYLES = [
    "I'm looking for {item} {rest}.",
    "Can you show me some {item} {rest}?",
    "I need {item} {rest}",
    "What {item} do you suggest {rest}?",
    "I want to compare {item} {rest}.",
    "Show me different {item} {rest}.",
    "I'm shopping for {item} {rest} Can you recommend a few?",
    "Looking for {item} alternatives {rest}.",
    "I need to choose between {item} {rest}.",
    "Can I see some {item} {rest}?",
]
PICK_LIST_REPLIES = [
    "I found {count} great options that match your requirements! {product_recommendations}",
    "Here are {count} excellent choices for you: {product_recommendations}",
    "Perfect! I've identified {count} products that fit your criteria: {product_recommendations}",
    "Great news! I found {count} options that meet your needs: {product_recommendations}",
    "I've got {count} solid recommendations for you: {product_recommendations}",
    "Here's what I recommend from your options: {product_recommendations}",
    "I found {count} products that should work well for you: {product_recommendations}",
    "Let me suggest {count} great choices: {product_recommendations}",
    "I've picked out {count} options that fit your requirements: {product_recommendations}",
    "Here are {count} products I think you'll like: {product_recommendations}",
]

# Templates of the reject task.
REJECT_STYLES = [
    "I'm hunting for {item} under ${price}{brand_clause}{feat_clause}{rating_clause}",
    "Do you have any {item}{feat_clause} for less than ${price}{brand_clause}{rating_clause}?",
    "Looking for {item}. Budget around ${price}{brand_clause}{feat_clause}{rating_clause}",
    "I need {item}{feat_clause}. Price cap is ${price}{brand_clause}{rating_clause}",
    "Could you recommend {item}{feat_clause} under ${price}{brand_clause}{rating_clause}?",
]
REJECT_OPENERS = [
    "Sorry, we don't currently have an exact match for that.",
    "I couldn't find an exact match for your request right now.",
    "Looks like we're out of anything that fits those exact specs.",
    "I can't find a perfect match at the moment.",
    "We don't have that exact configuration in stock right now.",
]
REJECT_SEGUES = [
    "However, here are the closest options I recommend:",
    "That said, these are the closest fits you might like:",
    "Meanwhile, these come closest to what you're after:",
    "In the meantime, consider these near-matches:",
    "Here are  some great alternatives that come close:",
]
FOREIGN_BRANDS = ["Hamilton Beach", "Ninja", "Instant Pot", "Breville", "Calphalon"]

# Templates and questions of the clarify task.
CLARIFY_STYLES = [
    "I'm shopping for a {item}{feat_hint}. My budget is flexible.{brand_hint}",
    "Looking for a {item}{feat_hint}. What's a good option?{brand_hint}",
    "Need a {item}{feat_hint}. Hoping to keep it affordable.{brand_hint}",
    "I'm after a {item}{feat_hint}. Not sure about price yet.{brand_hint}",
    "Can you suggest a {item}{feat_hint}? I can adjust the budget.{brand_hint}",
]
CLARIFY_OPENINGS = [
    "Happy to help! A couple of quick questions so I can dial this in:",
    "Got it. To recommend the best fit, could you clarify a few things?",
    "I can narrow this down. Mind answering a couple of quick questions?",
    "Thanks! A few details will help me tailor the options:",
]
CLARIFY_CLOSINGS = [
    "Once I have these, I'll shortlist the top matches.",
    "With that, I can recommend spot-on options.",
    "That'll help me zero in on the perfect picks.",
]
BUDGET_QUESTION = "- Do you have a rough budget cap (e.g., under ${mid})?"
FEATURE_QUESTION = "- Is {feature} a must-have, a nice-to-have, or not needed?"
BRAND_QUESTION = "- Any brands you prefer or want to avoid?"
TRADE_OFF_QUESTION = "- Are you prioritizing lower price, higher rating, or specific features?"
BRAND_OPEN_QUESTION = "- Would you prefer a well-known brand or are you open to lesser-known ones?"
TOPIC_QUESTIONS = [
    (["compact", "mini", "portable", "capacity", "large", "xl", "capacity"],
     "- Do you lean toward compact size or larger capacity?"),
    (["stainless", "steel", "glass", "plastic", "ceramic"],
     "- Any preference on material (e.g., stainless steel, glass, plastic)?"),
    (["easy clean", "dishwasher", "non-stick", "removable"],
     "- Is ease of cleaning important for you?"),
    (["programmable", "smart", "preset", "timer", "multi-speed", "variable speed", "speed settings"],
     "- Do you prefer simpler controls or more advanced features?"),
    (["quiet", "low noise"],
     "- Is quiet operation important, or is noise level not a concern?"),
    (["lightweight", "heavy-duty"],
     "- Do you want something lightweight or heavy-duty?"),
]
