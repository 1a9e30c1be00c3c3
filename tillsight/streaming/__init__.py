"""Every input of this library is bounded, so there are no streaming operators.

The row-wise pieces (``sources.delimited.parse_*``, ``functions.scalars``, ``operators.cleaning.drop_bad_towns``,
``plans.evaluation.split_label``) hold no state and can be applied to a ``readStream`` DataFrame as they are.
"""
