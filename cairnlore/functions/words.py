"""Fixed values of the text operators."""

#: English words left out by the tokeniser.
STOPWORDS = (
    "a an the and or but in on at to for of with by from is it as be was are were been has have had do does did will "
    "would could should may might this that these those not no if then else when which who whom what where how all "
    "each every both few more most other some such only own same so than too very can just about into through during "
    "before after above below between up"
).split()

#: Abbreviations and the words they stand for.
SYNONYMS = {
    "auth": "authentication", "db": "database", "api": "endpoint", "err": "error", "config": "configuration",
    "env": "environment", "repo": "repository", "msg": "message", "req": "request", "res": "response",
    "resp": "response", "ctx": "context", "fn": "function", "func": "function", "pkg": "package", "cmd": "command",
    "arg": "argument", "args": "arguments", "param": "parameter", "params": "parameters", "btn": "button",
    "nav": "navigation", "impl": "implementation", "init": "initialize", "util": "utility", "utils": "utilities",
    "lib": "library", "libs": "libraries", "dev": "development", "prod": "production", "dep": "dependency",
    "deps": "dependencies",
}

#: Suffixes that stemming strips, in order.
SUFFIXES = "ation tion ment ness able ible ing ous ive ful less ist ed ly er al es".split()

#: Words that are no key terms of a rule.
COMMON = "the a an and or but in on at to for of with by from is are was this that these those it not no can will should use used using because when".split()

#: What introduces a prohibited term.
PROHIBITIONS = ["avoid ", "ban ", "don't use ", "do not use ", "never use ", "prohibit ", "no "]

#: Letters with diacritics and their base letters, for full-text search.
ACCENTED, BASE = "àáâãäåçèéêëìíîïñòóôõöùúûüýÿ", "aaaaaaceeeeiiiinooooouuuuyy"
