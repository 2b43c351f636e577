"""English stop words."""

#: Frequent function words, as split by white space.
ENGLISH = tuple(
    sorted(
        set(
            """
            a about above after again against all almost also although always am among an and any are as at be became because been
            before being below between both but by can cannot could did do does doing done down during each either else etc even ever every
            few for from further get go had has have having he her here hers herself him himself his how however i if in into is it its
            itself just least less made many may me might more most much must my myself neither never no nor not now of off often on once
            one only or other our ours ourselves out over own per perhaps rather same say see seem seems she should since so some still such
            than that the their theirs them themselves then there these they this those though through thus to together too toward under
            until up upon us very via was we well were what when where whether which while who whom whose why will with within without
            would yet you your yours yourself
            """.split()
        )
    )
)
