"""Training-data operators. Nothing else in the library imports this subpackage.

``registry`` holds one query per operator and the SQL it is compared with.
"""
