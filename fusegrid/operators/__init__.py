"""DataFrame operators of the profile-fusion engine."""
