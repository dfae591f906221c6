"""Common English function words, the default for `terms`; pass your own list to replace it."""

ENGLISH = """
about above after again against all am an and any are as at be because been before being below
between both but by can could did do does doing down during each few for from further had has have
having he her here hers herself him himself his how if in into is it its itself just me more most my
myself no nor not now of off on once only or other our ours ourselves out over own same she should so
some such than that the their theirs them themselves then there these they this those through to too
under until up us very was we were what when where which while who whom why will with would you your
yours yourself yourselves
""".split()
