"""gridwork."""
