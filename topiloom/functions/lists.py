"""Fixed values shared by the Spark operators and their SQL counterparts."""

# English function words that keywords leave out.
STOP_WORDS = tuple(
    """a about above after again against all also am an and any are as at be because been before being below
    between both but by can could did do does doing down during each few for from further had has have having he
    her here hers him his how i if in into is it its just me more most my no nor not now of off on once only or
    other our out over own same she should so some such than that the their them then there these they this those
    through to too under until up very was we were what when where which while who whom why will with would you
    your""".split()
)

# Programme and column labels that are no news topic (regular expressions).
BLACKLIST = (
    r"grandstand",
    r"the\s*drum",
    r"abc\s*weather",
    r"extended\s*interview",
    r"country\s*hour",
    r"rural\s*news",
    r"national\s*rural",
    r"abc\s*news",
    r"news\s*exchange",
    r"capital\s*hill",
    r"breakfast\s*show",
    r"morning\s*program",
    r"afternoon\s*show",
    r"pm\s*news",
    r"world\s*today",
    r"correspondents\s*report",
    r"abc\s*sport",
    r"abc\s*entertainment",
)

# Seed words of the topic domains.
DOMAINS = {
    "sport": "sport afl nrl goal match coach cup win tigers blues raiders game final league player team stadium".split(),
    "politics": "election vote parliament polls senate labor liberal government pm minister party political candidate".split(),
    "crime": "crime police charged court murder arrest jail prison sentence convicted stabbing assault drug".split(),
    "disaster": "fire bushfire flood earthquake hurricane cyclone blaze firefighter evacuate damage emergency rescue".split(),
    "health": ["health", "hospital", "patient", "doctor", "medical", "disease", "covid", "vaccine", "mental", "aged care", "medicare"],
    "economy": "market budget economy price cost funding tax debt trade business shares stock profit mortgage".split(),
    "international": "war troops gaza israel iraq iran china russia ukraine refugee diplomat sanction treaty".split(),
    "weather": "weather rain storm cyclone temperature forecast humidity drought heatwave".split(),
    "education": "school university student teacher education college curriculum exam tuition".split(),
    "environment": "climate environment emission renewable solar wind carbon coal mining conservation species".split(),
    "transport": "road rail train bus highway traffic tunnel bridge airport flight transport".split(),
    "entertainment": "film movie music art festival concert celebrity award television".split(),
}
