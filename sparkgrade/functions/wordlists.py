"""Word lists of the keyword report. All of these are fixed values."""

# Common words that leave a gap.
STOPWORDS = """
a an all and are as at be between both but by can cannot could does do each for first
from given has have his how if in into is it its let least make may more must not now
of only on one or other over respectively show shown since so some such suppose than
that the their then there these they this to total two under use using what when where
whether which while who with without would
""".split()

# Wording of question items that leaves a gap.
ITEM_STOPWORDS = """
according along alpha analyze answer assume assumption bar calculate chapter choose
chooses choice compute conclude consider constant consumer consumers converted date
defined derive determine delta denote denotes drawn equation exceed exactly everything
exercise expression faced false final find following function functions given inspired
item judge large legally maximize maximizes model models number parameter parameters
problem prove question receiving same second small sign statement subject study symbol
symbols true unit verify
""".split()

# Broad terms of the field, kept on request.
GENERIC_STOPWORDS = """
cost costs demand firm firms good market payoff payoffs price prices profit profits
quantity
""".split()

# Phrases that are no topic on their own.
CANDIDATE_STOPWORDS = """
after any before between case common consumer converted date delta equal faces high iii
instead level lower low only per perfect pure rate split target they thus who zero
""".split()

# Word forms counted together.
TOKEN_ALIASES = {
    "buyers": "buyer",
    "buys": "buy",
    "charges": "charge",
    "consumers": "consumer",
    "firms": "firm",
    "markets": "market",
    "monopolists": "monopolist",
    "prices": "price",
    "products": "product",
    "produces": "produce",
    "profits": "profit",
    "sellers": "seller",
    "strategies": "strategy",
    "types": "type",
}

# Phrases counted together.
PHRASE_ALIASES = {
    "discount": "discount factor",
    "elasticity epsilon": "epsilon elasticity",
    "factor": "discount factor",
    "payments lump": "lump sum",
    "payments lump sum": "lump sum",
    "quality high": "high quality",
    "quality low": "low quality",
    "rate interest": "interest rate",
    "side payments lump": "side payments",
}

# Keywords reported when none are named.
SELECTED_KEYWORDS = ["equilibrium", "monopolist", "marginal", "discount factor"]
