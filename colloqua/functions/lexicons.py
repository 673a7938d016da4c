"""Word lists and patterns that fix results."""

#: Function words by category (fixed values).
FUNCTION_WORDS = {
    "articles": "a an the",
    "prepositions": "about above across after against along among around at before behind below beneath beside between beyond but by concerning despite down during except for from in inside into like near of off on onto out outside over past regarding since through throughout to toward under underneath until up upon with within without",
    "pronouns": "he her hers herself him himself his i it its itself me mine my myself our ours ourselves she that their theirs them themselves these they this those us we you your yours yourself yourselves",
    "aux_verbs": "am are be been being can could did do does doing had has have having is may might must shall should was were will would",
    "conjunctions": "although and because but for if nor or since so though unless whereas while yet",
    "negations": "aren't can't cannot couldn't didn't doesn't don't hadn't hasn't haven't isn't mustn't neither never no nobody none not nothing nowhere shouldn't wasn't weren't won't wouldn't",
    "adverbs_common": "almost already also always even here just maybe often only perhaps quite rather really sometimes soon still then there too usually very",
}
#: Keywords of typed code-block placeholders (fixed values).
FORMAL_KEYWORDS = ("model", "schema", "uml", "diagram", "binding", "acceptance criteria", "entity", "pipeline", "specification", "constraint", "invariant", "precondition", "postcondition", "ontology", "taxonomy", "relationship", "attribute")
CODE_KEYWORDS = ("def ", "class ", "import ", "from ", "function", "const ", "let ", "var ", "return", "select ", "where ", "insert ", "public ", "private ", "void ", "int ", "if (", "for (", "while (", "switch (")
CODE_SIGNS = ("{", "}", ";", "()", "=>", "->", "::")
#: General polarity lexicon of the default sentiment scorer; ``measures.scored`` takes any other.
POSITIVE = "good great better best excellent nice happy glad love loved like helpful useful easy fine thanks thank correct true success clear beautiful perfect wonderful amazing reliable safe pleasant enjoy enjoyed win won positive agree brilliant comfortable effective fair favourite fun gentle honest kind improve improved impressive strong welcome worth"
NEGATIVE = "bad worse worst wrong fail fails failed failure mistake mistakes problem problems hate hated difficult hard false error errors broken sorry sad angry awful terrible horrible poor ugly boring useless unsafe pain painful fear afraid lose lost negative disagree annoying confusing dangerous disappointing dirty unfair weak waste stupid sick ugly trouble unpleasant"
