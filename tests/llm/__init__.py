"""Tests of the operators for training data; a package, so that its modules may be named like those beside it."""
