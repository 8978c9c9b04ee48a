"""Every verifiable query of the library, with its SQL twin where SQL can say it."""
