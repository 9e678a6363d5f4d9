from feedloom.functions.urls import canonicalize_url

# Address as given, and as it is kept.
KEPT = {
    'HTTPS://Docs.Sample.NET/guide/?utm_campaign=spring&z=9&gclid=q&m=5#part-2': 'https://docs.sample.net/guide?m=5&z=9',
    'http://x.org': 'http://x.org/',
    'http://x.org///': 'http://x.org/',
    'http://x.org/a//b//': 'http://x.org/a//b',
    'example.com/a': 'https:example.com/a',
    '': 'https:///',
    '   ': 'https:///',
    '  https://x.org/a?q=1  ': 'https://x.org/a?q=1',
    'https://x.org/a?': 'https://x.org/a',
    'https://x.org/a?#': 'https://x.org/a',
    'https://x.org/?a=&b': 'https://x.org/?a=&b=',
    'https://x.org/?a=1&a=0&&a': 'https://x.org/?a=&a=0&a=1',
    'https://x.org/?q=a+b%20c': 'https://x.org/?q=a+b+c',
    'https://x.org/?q=%zz&r=%E4%BD%A0': 'https://x.org/?q=%25zz&r=%E4%BD%A0',
    'https://x.org/?q=%E4a%BD': 'https://x.org/?q=%EF%BF%BDa%EF%BF%BD',
    'https://x.org/?q=~a*b_c-d.e': 'https://x.org/?q=~a%2Ab_c-d.e',
    'https://x.org/?UTM_X=1&GCLID=2&k=v': 'https://x.org/?k=v',
    'https://x.org/?q=你好&ü=ß': 'https://x.org/?q=%E4%BD%A0%E5%A5%BD&%C3%BC=%C3%9F',
    '//cdn.x.org/p': 'https://cdn.x.org/p',
    'mailto:a@b.c': 'mailto:a@b.c',
    'file:///etc/x': 'file:///etc/x',
    'foo:bar?x=1': 'foo:bar?x=1',
    'foo:/bar/': 'foo:/bar',
    'https://User:Pw@Host:80/p;x=1?y': 'https://user:pw@host:80/p;x=1?y=',
    'https://x.org/a b?c d=e f': 'https://x.org/a b?c+d=e+f',
    'https:/a/b': 'https:///a/b',
    'https://x.org/a#b?c=d': 'https://x.org/a',
    'https://x.org?x=1': 'https://x.org/?x=1',
    'javascript:alert(1)': 'javascript:alert(1)',
    'https://[::1]:80/a': 'https://[::1]:80/a',
    'https://x.org/\ta\nb': 'https://x.org/ab',
    '1http://x/y': 'https:1http://x/y',
    'http:x': 'http:x',
    'https://x.org/?a=b=c&=d&=': 'https://x.org/?=&=d&a=b%3Dc',
    'HTTP://É.com/É': 'http://é.com/É',
    'https://x.org/?q=%F0%9F%98%80&e=😀': 'https://x.org/?e=%F0%9F%98%80&q=%F0%9F%98%80',
    'https://x.org/?a%26b=c%3Dd': 'https://x.org/?a%26b=c%3Dd',
    'https:////a//b': 'https:////a//b',
    '////a': 'https:////a',
    'https://x.org/?b=%25zz&utm_%20=1': 'https://x.org/?b=%25zz',
    'https://x.org/?%75tm_source=1': 'https://x.org/',
    '\x00\x1f https://x.org/a': 'https://x.org/a',
}


def test_canonical_urls(column):
    assert dict(zip(KEPT, column(canonicalize_url, list(KEPT)))) == KEPT


def test_unreadable_hosts_give_null(column):
    assert column(canonicalize_url, ["https://[::1/a", "https://a]/b", "https://a／b.org/c"]) == [None] * 3
