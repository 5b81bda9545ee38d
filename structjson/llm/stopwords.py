"""Frequent function words of the corpora's languages, lower-case."""

_EN = "a all an and are as at be been but by can for from had has have he her his if in is it its not of on or she that the their there they this to was we were which who will with you"
_DE = "aber als am an auch auf aus bei das dass dem den der des die ein eine einem einen einer er es für hat ich im in ist mit nach nicht sich sie sind um und von war wie wird zu"
_FR = "au aux avec ce ces cette dans de des du elle en est et il ils je la le les leur mais ne nous on ou par pas plus pour que qui sa se ses son sont sur un une vous"
_ES = "a al como con de del el ella en entre es esta este fue ha hay la las lo los más no o para pero por que se ser si sin sobre son su sus también un una y ya"

STOPWORDS = frozenset(" ".join((_EN, _DE, _FR, _ES)).split())
