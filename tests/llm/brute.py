"""The operators' contracts, worked out one row at a time in plain Python."""
import re, hashlib
sha=lambda s: hashlib.sha256(s.encode()).hexdigest()
A=re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",re.I|re.A)
def op1(t):
    t=t or ''; s=[]
    s+=[('assign',m.start(),m.end()) for m in A.finditer(t) if len(m[2])>=6]
    s+=[('access',m.start(),m.end()) for m in re.finditer('AKIA[A-Z0-9]+',t) if len(m[0])>=20]
    s+=[('hex',m.start(),m.end()) for m in re.finditer('[0-9a-f]+',t) if len(m[0])>=24]
    k=['assign','access','hex']; n=[sum(x[0]==y for x in s) for y in k]
    s.sort(key=lambda x:(x[1],k.index(x[0])))
    return (*n,sha(','.join(f'{a}:{b}:{c}' for a,b,c in s)))
def luhn(d):
    return sum((int(c) if i%2==0 else (int(c)*2-9 if int(c)>4 else int(c)*2)) for i,c in enumerate(reversed(d)))%10==0
def op6(t):
    t=t or ''; k=['email','ip','card','phone']; s=[]
    dig=lambda x: re.sub('[^0-9]','',x)
    s+=[('email',m.start(),m.end()) for m in re.finditer(r'[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+',t)]
    s+=[('ip',m.start(),m.end()) for m in re.finditer(r'[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)',t) if all(int(x)<=255 for x in m[0].split('.'))]
    s+=[('card',m.start(),m.end()) for m in re.finditer(r'[0-9]([\x20-]?[0-9])+',t) if 13<=len(dig(m[0]))<=19 and luhn(dig(m[0]))]
    s+=[('phone',m.start(),m.end()) for m in re.finditer(r'\+[0-9][\x20().0-9-]+[0-9]',t) if 9<=len(dig(m[0]))<=15]
    n=[sum(x[0]==y for x in s) for y in k]
    return (*n,sha(','.join(f'{a}:{b}:{c}' for a,b,c in sorted(s,key=lambda x:(k.index(x[0]),x[1])))))
W=re.compile(r'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')
low=lambda t: ''.join(chr(ord(c)+32) if 'A'<=c<='Z' else c for c in (t or ''))
def op4(t):
    w=W.findall(low(t)); b=[]
    for p,l in (('mit license','mit'),('apache license','apache'),('general public license','gpl')):
        p=p.split(); b+=[(i,l) for i in range(len(w)) if w[i:i+len(p)]==p]
    return (len(w),len(b),min((i for i,_ in b),default=None),max((i for i,_ in b),default=None),','.join(sorted({l for _,l in b})))
def op9(docs,items,k=10):
    win={}
    for i,t in items:
        w=W.findall(low(t))
        for s in range(max(1,len(w)-k+1)) if w else ():
            win.setdefault(tuple(w[s:s+k]),set()).add(i)
    lens={len(x) for x in win}; out={}
    for d,t in docs:
        w=W.findall(low(t)); hit=[0]*len(w); its=set()
        for n in lens:
            for s in range(len(w)-n+1):
                x=tuple(w[s:s+n])
                if x in win: its|=win[x]; hit[s:s+n]=[1]*n
        out[d]=(len(w),sum(hit),len(its),sha(','.join(sorted(map(str,its)))),sum(hit)>0)
    return out
def op3(docs,k=50):
    first={}
    ws={d:re.findall(r'[^\x20\x09-\x0D]+',t or '') for d,t in docs}
    for d in sorted(ws):
        w=ws[d]
        for s in range(len(w)-k+1): first.setdefault(tuple(w[s:s+k]),d)
    out={}
    for d,w in ws.items():
        c=[0]*len(w)
        for s in range(len(w)-k+1):
            if first[tuple(w[s:s+k])]<d: c[s:s+k]=[1]*k
        out[d]=(len(w),sum(c),sha(' '.join(x for x,y in zip(w,c) if not y)))
    return out
def op7(docs):
    S={}
    for d,t in docs:
        w=re.findall(r'[^\x20\x09-\x0D]+',low(t))
        S[d]=frozenset(tuple(w[i:i+3]) for i in range(max(1,len(w)-2))) if w else frozenset()
    inv={}
    for d,s in S.items():
        for x in s: inv.setdefault(x,[]).append(d)
    par={d:d for d in S}
    def find(x):
        while par[x]!=x: par[x]=par[par[x]]; x=par[x]
        return x
    from collections import Counter
    for d,s in S.items():
        c=Counter(e for x in s for e in inv[x] if e<d)
        for e,n in c.items():
            if 100*n>=85*(len(s)+len(S[e])-n):
                a,b=find(d),find(e); par[max(a,b)]=min(a,b)
    return {d:(len(S[d]),find(d),find(d)==d) for d in S}
def op12(docs, least=10, top=10):
    from collections import Counter
    from fractions import Fraction
    from math import floor
    docs=[(l or '',s or '',re.findall(r'[^\x00-\x40\x5B-\x60\x7B-\x7F]+',low(t))) for l,s,t in docs]
    out=[]
    for lang in {l for l,_,_ in docs}:
        mine=[(s,w) for l,s,w in docs if l==lang]
        seen=Counter(t for _,w in mine for t in set(w))
        kept=sorted((t for t,n in seen.items() if n>=least), key=str.encode)
        def p(words):
            c=Counter(t for t in words if seen[t]>=least); n=sum(c.values())
            return c,{t: 1+floor(Fraction(10**9*(c[t]+2),n+2*len(kept))) for t in kept}
        _,q=p(t for _,w in mine for t in w)
        of={s: p(t for x,w in mine if x==s for t in w) for s,_ in mine}
        f=lambda a,b: floor(Fraction((a-b)**2,a+b))
        for s,(c,a) in of.items():
            pairs=sorted((-sum(f(a[t],b[t]) for t in kept),o.encode()) for o,(_,b) in of.items() if o!=s)
            own=sorted((-f(a[t],q[t]),t.encode()) for t in kept if c[t]>0 and a[t]>q[t])[:top]
            out+=[(lang,s,part,i.decode(),-v,k) for part,found in (('pair',pairs),('term',own)) for k,(v,i) in enumerate(found,1)]
    return sorted(out)
def op13(docs, support=100, first=2000):
    from collections import Counter
    n=Counter(); f=Counter()
    for lang,t in docs:
        lang='und' if lang is None else lang
        for piece in re.split(r'[.,;:!?\x0A-\x0D]', low(t)):
            w=re.findall(r'[^\x20\x09]+',piece); n[lang]+=len(w)
            for m in range(1,6):
                for i in range(len(w)-m+1): f[lang,tuple(w[i:i+m])]+=1
    cand={k:a for k,a in f.items() if len(k[1])>1 and a>=support}; gone=set()
    for (lang,p),a in cand.items():
        for m in range(2,len(p)):
            for i in range(len(p)-m+1):
                q=(lang,p[i:i+m])
                if a>=cand[q]: gone.add(q)
    out=[]
    for (lang,p),a in cand.items():
        if (lang,p) in gone: continue
        s,k=min((1000*a*n[lang]//(f[lang,p[:k]]*f[lang,p[k:]]),k) for k in range(1,len(p)))
        out.append((lang,-s,-a,' '.join(p).encode(),f[lang,p[:k]],f[lang,p[k:]],n[lang]))
    out.sort(); res=[]; c=Counter()
    for lang,s,a,p,l,r,x in out:
        c[lang]+=1
        if c[lang]<=first: res.append((lang,c[lang],p.decode(),-a,l,r,x,-s))
    return sorted(res)


def shared(children, total):
    """``children``: name -> (weight, capacity). Water filling by rounds, then largest remainders."""
    left, got = dict(children), {}
    while left:
        weights = sum(w for w, _ in left.values())
        full = [n for n, (w, c) in left.items() if c * weights <= total * w]
        if not full:
            break
        for n in full:
            got[n] = left.pop(n)[1]
        total -= sum(got[n] for n in full)
    weights = sum(w for w, _ in left.values())
    parts = {n: divmod(w * total, weights) for n, (w, _) in left.items()}
    spare = total - sum(q for q, _ in parts.values()) if parts else 0
    order = sorted(parts, key=lambda n: (-parts[n][1], -left[n][0], hashlib.md5(n.encode()).hexdigest(), n))
    return got | {n: parts[n][0] + (i < spare) for i, n in enumerate(order)}


def budgets(leaves, weights, total, epochs, other):
    """``leaves``: (domain, lang, source) -> tokens; ``weights``: (level, name) -> weight. Budget of each leaf."""
    out = {}

    def descend(path, total):
        level = ("domain", "lang", "source")[len(path)]
        names = {leaf[len(path)] for leaf in leaves if leaf[: len(path)] == path}
        children = {n: (weights.get((level, n), other), epochs * sum(t for leaf, t in leaves.items() if leaf[: len(path) + 1] == (*path, n))) for n in names}
        for n, budget in shared(children, total).items():
            if len(path) == 2:
                out[*path, n] = budget
            else:
                descend((*path, n), budget)

    descend((), total)
    return out
